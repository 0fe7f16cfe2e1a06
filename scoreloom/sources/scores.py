"""Score files: archives, MusicXML measures and features, LilyPond text.

Parsing needs a tree or a state machine, so it runs in Python, in Arrow batches, once
per file; everything after is columns.
"""

from __future__ import annotations

import io
import re
import statistics
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.exprs import FRETS, OPEN_STRINGS, SEMITONES

# ---------------------------------------------------------------- fixed values
DENOMINATORS = {"whole": 1, "half": 2, "quarter": 4, "eighth": 8, "16th": 16, "32nd": 32, "64th": 64, "128th": 128}
SHARPS, FLATS = "FCGDAEB", "BEADGCF"
GUITAR_WORDS = ("guitar", "gitarre", "guitare", "guitarra")
GUITAR_PROGRAMS = range(24, 29)  # counted from 0
DEFAULT_TEMPO = 100.0
# ---------------------------------------------------------------- end of fixed values


def local(el) -> str:
    return el.tag.rsplit("}", 1)[-1] if isinstance(el.tag, str) else ""


def child(el, name: str):
    return next((c for c in el if local(c) == name), None)


def text_of(el, name: str) -> str | None:
    c = None if el is None else child(el, name)
    return None if c is None or c.text is None else c.text


def descend(el, *names: str):
    for n in names:
        el = None if el is None else child(el, n)
    return el


def open_score(blob: bytes, fmt: str) -> tuple[bytes | None, str | None]:
    """The score's XML out of a file: of an archive the root file that its container
    names, else the first XML outside META-INF. (xml, None) or (None, reason)."""
    if fmt != "mxl":
        return blob, None
    try:
        z = zipfile.ZipFile(io.BytesIO(blob))
    except zipfile.BadZipFile:
        return None, "bad_zip"
    names = z.namelist()
    try:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        for el in container.iter():
            if local(el) == "rootfile" and el.get("full-path") in names:
                return z.read(el.get("full-path")), None
    except (KeyError, ET.ParseError):
        pass
    for n in names:
        if not n.startswith("META-INF") and n.lower().endswith((".xml", ".musicxml")):
            return z.read(n), None
    return None, "no_score_in_archive"


def parse(xml: bytes) -> tuple[ET.Element | None, str | None]:
    """(root, None), or (None, code) for malformed XML and other documents. External
    entities are not read; a DOCTYPE is allowed."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError, LookupError):
        return None, "XML_MALFORMED"
    return (root, None) if local(root) in ("score-partwise", "score-timewise") else (None, "XML_NOT_MUSICXML")


def whole(s: str | None) -> int | None:
    try:
        return int(s)
    except (TypeError, ValueError):
        return None


def real(s: str | None) -> float | None:
    try:
        return float(s)
    except (TypeError, ValueError):
        return None


def midi(pitch) -> int | None:
    step, octave = text_of(pitch, "step"), whole(text_of(pitch, "octave"))
    semi = SEMITONES.get((step or "").upper())
    if semi is None or octave is None:
        return None
    alter = real(text_of(pitch, "alter"))
    return (octave + 1) * 12 + semi + (int(alter) if alter is not None and abs(alter) < 100 else 0)


def low_fret(m: int) -> int | None:
    return min((m - s for s in OPEN_STRINGS if 0 <= m - s <= FRETS), default=None)


def key_alters(fifths: int) -> dict[str, int]:
    """What a key signature does to each step."""
    steps, sign = (SHARPS, 1) if fifths > 0 else (FLATS, -1)
    return {s: sign for s in steps[: min(abs(fifths), 7)]}


def quarters(root) -> float | None:
    """Length of the first part in quarters: voice 1 or none, chord tones not counted
    again, forwards counted, divisions as last set (anywhere in the measure)."""
    part = next((e for e in root.iter() if local(e) == "part"), None)
    if part is None:
        return None
    divisions, total = None, 0.0
    for m in part:
        if local(m) != "measure":
            continue
        for el in m.iter():
            if local(el) == "divisions" and whole(el.text) is not None:
                divisions = whole(el.text)
        if not divisions:
            continue
        length = 0
        for c in m:
            kind = local(c)
            if kind == "note":
                voice = text_of(c, "voice")
                if voice is not None and voice.strip() != "1" or child(c, "chord") is not None:
                    continue
            elif kind != "forward":
                continue
            length += whole(text_of(c, "duration")) or 0
        total += length / divisions
    return total if total > 0 else None


def features(root) -> dict:
    """The musical features of one score. Polyphony follows the published numbers: a
    measure counts as polyphonic once any measure so far had a chord; the per-measure
    reading is ``polyphonic_measure_share``."""
    out: dict = {}
    counts = dict.fromkeys(("mordent", "inverted-mordent", "trill-mark", "turn", "inverted-turn", "harmonic", "barre", "grace", "dot", "tie", "tuplet"), 0)
    pitches, frets, melodic, sigs, fifths, denominators, tempi, minutes = [], [], [], [], [], [], [], []
    n_notes = n_measures = sounding = outside = 0
    last_fret: dict[str, int] = {}
    jumps, fingered = 0, False
    parents = {c: p for p in root.iter() for c in p}
    for el in root.iter():
        kind = local(el)
        up = parents.get(el)
        over = local(up) if up is not None else ""
        if kind == "measure":
            n_measures += 1
        elif kind == "note":
            n_notes += 1
            pitch = child(el, "pitch")
            if child(el, "rest") is None and over == "measure":
                sounding += 1
            m = None if pitch is None else midi(pitch)
            if m is not None:
                pitches.append(m)
                f = low_fret(m)
                if f is not None:
                    frets.append(f)
                    if child(el, "chord") is None:
                        melodic.append(f)
            technical = descend(el, "notations", "technical")
            s, f = text_of(technical, "string"), None if technical is None else child(technical, "fret")
            if technical is not None and child(technical, "string") is not None and f is not None:
                fingered = True
                fret = whole((f.text or "0").strip())
                if fret is not None:
                    string = (s or "").strip()
                    if string in last_fret and abs(fret - last_fret[string]) > 4:
                        jumps += 1
                    last_fret[string] = fret
        elif kind == "type" and over == "note":
            d = DENOMINATORS.get((el.text or "").strip().lower())
            if d:
                denominators.append(d)
        elif kind in ("mordent", "inverted-mordent", "trill-mark", "turn", "inverted-turn"):
            counts[kind] += over == "ornaments"
        elif kind in ("harmonic", "barre"):
            counts[kind] += over == "technical"
        elif kind in ("grace", "dot", "tie"):
            counts[kind] += over == "note"
        elif kind == "tuplet":
            counts[kind] += over == "notations"
        elif kind == "time":
            b, t = text_of(el, "beats"), text_of(el, "beat-type")
            if b and t:
                sigs.append(f"{b.strip()}/{t.strip()}")
        elif kind == "fifths" and over == "key" and (el.text or "").strip():
            fifths.append(el.text.strip())
        elif kind == "sound" and real(el.get("tempo")) is not None:
            tempi.append(real(el.get("tempo")))
        elif kind == "per-minute" and real((el.text or "").strip()) is not None:
            minutes.append(real((el.text or "").strip()))
    for part in (e for e in root.iter() if local(e) == "part"):
        alters: dict[str, int] = {}
        for el in part.iter():
            kind = local(el)
            if kind == "fifths" and el.text and whole(el.text.strip()) is not None:
                alters = key_alters(whole(el.text.strip()))
            elif kind == "note" and child(el, "pitch") is not None:
                p = child(el, "pitch")
                step = (text_of(p, "step") or "").strip().upper()
                if not step:
                    continue
                written = (text_of(p, "alter") or "").strip()
                value = int(real(written)) if real(written) is not None else None if written else 0
                outside += value is not None and value != alters.get(step, 0)
    stack_max = voices_max = poly = poly_share = 0
    for m in (e for e in root.iter() if local(e) == "measure"):
        voices, stack, own = set(), 0, 0
        for n in (c for c in m if local(c) == "note"):
            v = text_of(n, "voice")
            if v:
                voices.add(v.strip())
            stack = stack + 1 if child(n, "chord") is not None else 0
            if stack:
                own = max(own, stack + 1)
        stack_max, voices_max = max(stack_max, own), max(voices_max, len(voices))
        poly += stack_max >= 2 or len(voices) >= 2
        poly_share += own >= 2 or len(voices) >= 2
    tempo = tempi[0] if tempi else minutes[0] if minutes else None
    sig = sigs[0] if sigs else ""
    seconds = None
    try:
        if tempo and sig and n_measures:
            beats, beat_type = sig.split("/")
            seconds = round(float(beats) * 4.0 / int(beat_type) * n_measures / tempo * 60.0, 1)
    except (ValueError, ZeroDivisionError):
        seconds = None
    if seconds is None and (q := quarters(root)) is not None:
        seconds = round(q / (tempo or DEFAULT_TEMPO) * 60.0, 1)
    ordered = sorted(frets)
    out.update(
        midi_min=min(pitches, default=None), midi_max=max(pitches, default=None), midi_range=max(pitches) - min(pitches) if pitches else None,
        midi_median=round(float(statistics.median(pitches)), 1) if pitches else None,
        key_fifths=fifths[0] if fifths else "", key_changes=len(set(fifths)), tempo_bpm=tempo, time_sig=sig, meter_changes=len(set(sigs)),
        smallest_division=max(denominators, default=None), dotted_count=counts["dot"], tied_count=counts["tie"], tuplet_count=counts["tuplet"],
        notes_per_measure=round(sounding / n_measures, 1) if n_measures else None, accidentals_outside_key=outside, max_chord_stack=stack_max,
        polyphonic_measure_ratio=round(poly / n_measures, 3) if n_measures else 0.0, polyphonic_measure_share=round(poly_share / n_measures, 3) if n_measures else 0.0, voice_count_max=voices_max,
        ornament_mordent=counts["mordent"] + counts["inverted-mordent"], ornament_trill=counts["trill-mark"], ornament_turn=counts["turn"] + counts["inverted-turn"],
        grace_count=counts["grace"], harmonic_count=counts["harmonic"], barre_count=counts["barre"], position_shift_proxy=jumps if fingered else None,
        pitch_min_fret_max=max(frets, default=None), pitch_min_fret_p90=ordered[max(0, min(len(ordered) - 1, round(0.9 * (len(ordered) - 1))))] if frets else None,
        pitch_position_shifts=sum(abs(a - b) >= 4 for a, b in zip(melodic, melodic[1:])) if frets else None,
        measure_count=n_measures, note_count=n_notes, duration_sec_approx=seconds,
    )
    return out


FEATURE_SCHEMA = (
    "midi_min int, midi_max int, midi_range int, midi_median double, key_fifths string, key_changes int, tempo_bpm double, time_sig string, meter_changes int, smallest_division int, dotted_count int, "
    "tied_count int, tuplet_count int, notes_per_measure double, accidentals_outside_key int, max_chord_stack int, polyphonic_measure_ratio double, polyphonic_measure_share double, voice_count_max int, "
    "ornament_mordent int, ornament_trill int, ornament_turn int, grace_count int, harmonic_count int, barre_count int, position_shift_proxy int, pitch_min_fret_max int, pitch_min_fret_p90 int, "
    "pitch_position_shifts int, measure_count int, note_count int, duration_sec_approx double"
)
MEASURES_SCHEMA = "error string, parts int, tokens array<string>, clefs array<string>, staves int, tab_staves int, pitched int, lowest int, title string, composer string, opus string, key string"


def measures(xml: bytes | None, reason: str | None) -> dict:
    """What the gates of validation look at, or the error that ends it before."""
    out = dict(error=reason, parts=None, tokens=[], clefs=[], staves=None, tab_staves=None, pitched=None, lowest=None, title="", composer="", opus="", key="")
    if xml is None:
        out["error"] = "MXL_EXTRACTION_FAILED"
        return out
    root, error = parse(xml)
    if root is None:
        out["error"] = error
        return out
    out["parts"] = sum(local(e) == "score-part" for e in root.iter())
    tokens, clef_numbers, tabs = [], set(), set()
    for e in root.iter():
        kind, t = local(e), (e.text or "").strip()
        if kind in ("part-name", "instrument-name", "instrument-sound", "part-abbreviation") and t:
            tokens.append(t)
        elif kind == "midi-program" and whole(t) is not None and whole(t) - 1 in GUITAR_PROGRAMS:
            tokens.append(f"midi-program-{whole(t)}")
        elif kind == "clef":
            sign = (text_of(e, "sign") or "").strip().upper()
            number = e.get("number") or "1"
            clef_numbers.add(number)
            if sign:
                out["clefs"].append(sign)
            if sign == "TAB":
                tabs.add(number)
    out["tokens"], out["clefs"] = tokens, sorted(set(out["clefs"]))
    out["staves"], out["tab_staves"] = len(clef_numbers), len(tabs)
    notes = [e for e in root.iter() if local(e) == "note"]
    out["pitched"] = sum(child(n, "rest") is None for n in notes)
    out["lowest"] = min((m for n in notes if child(n, "pitch") is not None and (m := midi(child(n, "pitch"))) is not None), default=None)

    def first(*path):
        for e in root.iter():
            if local(e) == path[0]:
                got = descend(e, *path[1:])
                if got is not None and (got.text or "").strip():
                    return got.text.strip()
        return ""

    out["title"] = first("work", "work-title") or first("movement-title")
    out["opus"], out["key"] = first("work", "work-number"), first("key", "fifths")
    for e in root.iter():
        if local(e) == "identification":
            for c in e:
                kind = (c.get("type") or "").lower()
                if local(c) == "creator" and kind in ("composer", "") and (c.text or "").strip():
                    out["composer"] = c.text.strip()
                    if kind == "composer":
                        break
    return out


def read_scores(files: DataFrame, what: str = "features") -> DataFrame:
    """``files`` (id, content, format) parsed: (id, error, features...) or (id,
    measures...). Unreadable files give a row with the error and nulls; null content
    counts as unreadable."""
    schema = f"id string, error string, {FEATURE_SCHEMA}" if what == "features" else f"id string, {MEASURES_SCHEMA}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, blob, fmt in zip(pdf["id"], pdf["content"], pdf["format"]):
                xml, reason = (None, "no_content") if blob is None else open_score(bytes(blob), fmt)
                if what != "features":
                    rows.append({"id": i, **measures(xml, reason)})
                    continue
                root, error = (None, "MXL_EXTRACTION_FAILED") if xml is None else parse(xml)
                rows.append({"id": i, "error": error, **({} if root is None else features(root))})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=names)

    return files.select("id", "content", "format").mapInPandas(run, schema)


# LilyPond text ---------------------------------------------------------------

_TRIVIA = re.compile(r'%\{.*?%\}|%[^\n]*|"(?:\\.|[^"\\])*"', re.S)


def blank_comments(src: str) -> str:
    """Comments and strings blanked by spaces of the same length, line breaks kept, so
    that places stay the same."""
    return _TRIVIA.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), src)


def close_brace(scan: str, start: int) -> int:
    """The place after the brace that closes the one at ``start``; -1 if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(scan, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return -1


def score_blocks(src: str) -> list[str]:
    """The top-level score blocks of a LilyPond file, as text."""
    scan, out, at = blank_comments(src), [], 0
    for m in re.finditer(r"\\score\s*\{", scan):
        if m.start() < at:
            continue
        end = close_brace(scan, m.end() - 1)
        if end > 0:
            out.append(src[m.start() : end])
            at = end
    return out


def header_fields(src: str) -> dict[str, str]:
    """The fields of the first header block; the last of equal names counts."""
    scan = blank_comments(src)
    m = re.search(r"\\header\s*\{", scan)
    if not m:
        return {}
    body = src[m.end() : close_brace(scan, m.end() - 1)]
    return {k: v.replace('\\"', '"') for k, v in re.findall(r'(?m)^\s*([A-Za-z][\w-]*)\s*=\s*(?:\\markup\s*)?"((?:\\.|[^"\\])*)"', body)}


def without_header(src: str) -> str:
    """The text without its first header block."""
    scan = blank_comments(src)
    m = re.search(r"\\header\s*\{", scan)
    end = close_brace(scan, m.end() - 1) if m else -1
    return src[: m.start()] + src[end:] if end > 0 else src


def tab_as_staff(src: str) -> str:
    """Tablature contexts under the names of ordinary ones."""
    return re.sub(r"\bTab(Staff|Voice)\b", r"\1", src)


_TAB = re.compile(r"\\(?:(?:new|context)\s+)?TabStaff\b\s*(?=\{|<<)")


def without_tab(src: str) -> str:
    """The text without tablature blocks, in braces or double angle brackets; one that
    has a name or never closes stays."""
    scan, kept, at = blank_comments(src), [], 0
    for m in _TAB.finditer(scan):
        if m.start() < at:
            continue
        opens, closes = ("{", "}") if scan[m.end()] == "{" else ("<<", ">>")
        depth, end = 0, -1
        for t in re.finditer(f"{opens}|{closes}", scan[m.end() :]):
            depth += 1 if t.group() == opens else -1
            if depth == 0:
                end = m.end() + t.end()
                break
        if end > 0:
            kept.append(src[at : m.start()])
            at = end
    return "".join(kept) + src[at:]


REWRITES = {"header": without_header, "rename": tab_as_staff, "drop": without_tab}


def rewrite(files: DataFrame, kind: str) -> DataFrame:
    """(id, text) after one of the ``REWRITES``; null stays null."""
    change = REWRITES[kind]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[None if t is None else change(t) for t in pdf["text"]])

    return files.select("id", "text").mapInPandas(run, "id string, text string")


def split_lilypond(files: DataFrame) -> DataFrame:
    """One row per score block of each file (id, text): (id, movement, block, title,
    composer); files without one give a row of movement 0."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                h = header_fields(text or "")
                blocks = score_blocks(text or "")
                for k, b in enumerate(blocks or [None]):
                    rows.append((f"{i}#movement{k + 1:02d}" if len(blocks) > 1 else i, k + 1 if blocks else 0, b, h.get("title"), h.get("composer")))
            yield pd.DataFrame(rows, columns=["id", "movement", "block", "title", "composer"])

    return files.select("id", "text").mapInPandas(run, "id string, movement int, block string, title string, composer string")
