"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import abuse, canonical, capping, encoding, leaks, percentiles, pieces, splits, variants

QUERIES = {
    "p1_found": capping.p1_found,
    "p1_capped": capping.p1_capped,
    "p2_found": variants.p2_found,
    "p2_classes": variants.p2_classes,
    "p3_found": pieces.p3_found,
    "p3_matches": pieces.p3_matches,
    "p5_percentiles": percentiles.p5_percentiles,
    "p5_overall": percentiles.p5_overall,
    "p5_bounded": percentiles.p5_bounded,
    "p6_split": splits.p6_split,
    "p6_balance": splits.p6_balance,
    "p7_found": canonical.p7_found,
    "p7_era_counts": canonical.p7_era_counts,
    "p8_ids": encoding.p8_ids,
    "p8_token_counts": encoding.p8_token_counts,
    "p9_found": leaks.p9_found,
    "p9_items": leaks.p9_items,
    "p10_found": abuse.p10_found,
    "p10_scores": abuse.p10_scores,
    "p10_rates": abuse.p10_rates,
}

SQL: dict[str, str] = {**capping.SQL, **percentiles.SQL}
