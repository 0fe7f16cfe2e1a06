"""Names of people as typed: repair, parsing and comparison.

Everything here is plain Python on single strings; the operators call it inside
``mapInPandas`` over *distinct* spellings, never over rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

from .text import delook, fold, is_cyrillic, repair

# ---------------------------------------------------------------- fixed values
# Cyrillic letters as they stand for Latin ones in transliterated names.
CYRILLIC = dict(
    zip(
        "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґў",
        "a b v g d e z z i j k l m n o p r s t u f h c h S S _ y _ e u a e i i e g u".split(),
    )
)
LEET = str.maketrans("0134578$@", "oleastbsa")
PARTICLES = frozenset("van von vom zu zum zur de da do dos das di del della dei des du la le el los las af av ter ten der den y e the il ван вон фон де да ди дел делла дос".split())
TITLES = frozenset("don dona doña sr sra srta senor senora mr mrs ms miss mister prof professor dr doctor maestro maestra mtro sir lady lord herr frau fr mme mlle madame monsieur mons sig signor signora sigra rev pater padre frater fray abbe hr".split())
ROLES = frozenset("comp composer composed by attrib attributed attr attribution to after nach d'apres compositor compositeur komponist compositore zugeschrieben atribuido attribue von_ composto compuesto compose".split())
NOTES = frozenset("arr arranged arrangement arrangiert arreglo transcr transcribed transcription trans ed edited edition edit rev revised bearb bearbeitet bearbeitung adapt adapted harm for fur fuer pour para per from aus orch".split())
ELDER = frozenset("i 1 sr senior elder vecchio viejo pere aine altere aeltere pai ältere".split())
YOUNGER = frozenset("ii 2 jr jnr junior younger giovane joven fils jeune jungere juengere filho hijo jüngere".split())
UNNAMED = frozenset(
    "anon anonymous anonym anonyme anonymus anonimo anonima anonymer anonymo anons unbekannt unbekannter unbekannte desconocido desconocida inconnu inconnue "
    "unknown sconosciuto ignoto ignota onbekend unnamed verfasserunbekannt".split()
)
UNNAMED_WITH = frozenset(
    "author autor auteur autore artist composer compositor compositeur komponist compositore maestro meister master maestro lute book lautenbuch laud century jh siglo siecle sec saec "
    "c cent veneziano veneziana spanish english french italian german espanol francais italiano deutsch source manuscript ms hand scribe th st nd rd the of verfasser tonsetzer".split()
)
FOLK = frozenset(
    "trad traditional traditionals tradicional traditionnel traditionnelle traditionell tradizionale folk folksong folklore folklor volksweise volkslied volksmusik popular populaire popolare popolari "
    "tradit tradition".split()
)
FOLK_WITH = frozenset(
    "song songs tune air melody melodia melodie cancion canto canzone chanson lied weise dance danza danse arr arranged irish english scottish spanish french german italian catalan andaluz andaluza "
    "espanol espanola vieja old ancient music musica musique melodi".split()
)
NOISE = frozenset(
    "various varios diverse divers verschiedene vari autores authors artists artistas composers tbd tba todo na n a null none nil nan given not composer file unknown see page of mxl xml musicxml pdf midi mid score scores "
    "guitar guitars guitarra guitare gitarre chitarra solo soli duo trio lute two three four op opus no nr study etude estudio studie minor major moll dur allegretto allegro andante andantino moderato lento "
    "largo adagio presto vivace waltz valse prelude edited from manuscript ref untitled title ohne sin sans name nome nom nombre test copyright public domain edition unspecified missing empty blank undefined "
    "default arranger editor arr for in the and y und et by comp page seite pagina error value part parts vol book untitledscore title1 composer1".split()
)
# Familiar names that no rule (see ``familiar``) brings to the name they stand for.
NICKNAMES_TEXT = """
adele: adela adelina ada | agnes: ines agna neza | alberto: beto tito | alexander: sandro sascha sasha alec | alexei: alyosha | alois: loisl | ann: nancy | anselm: anselmo selmo
anthony: tony | antonio: toni tono antoine | august: gustl | bartolome: bartel mea | beatriz: trixi | bernhard: bernd | brigitte: gitta britta biggi | caspar: kaspar
catherine: cate kate kitty katie | charles: chuck chas | christopher: kit | concepcion: concha | cosima: cosma | daniela: ela | dietrich: dieter dirk | dmitri: mitya dima
dolores: lola | domenico: mimmo mingo | dorothea: dora dorle dot | edmund: ed eddie ned mundi | eduardo: lalo | eleonora: leonora lena ella | elisabeth: lisl sissi lison
elizabeth: liz lizzie betty bess | emilio: milo | enrique: kike quique | ernesto: neto | etienne: stephane steve tienne | evgeni: zhenya | ferdinando: fernando | filippo: pippo
francesco: ciccio cecco | francisco: paco pancho curro kiko quico | frantisek: franta | friedrich: fritz fredl fred | gaspard: gasparo | georg: schorsch jorg
gertrud: trude trudi gerda | giovanni: gianni nino | giuseppe: beppe peppe peppino pino | gonzalo: chalo | gregorio: goyo | grigori: grisha | guillermo: memo | hedwig: wiggi
heinrich: heinz heiner | henry: harry hank | hilarion: hilo | hortense: hortensia | ignacio: nacho | ignaz: naz | ilse: ilsa | isidro: sidro | ivan: vanya | jakub: kuba jacob
james: jas jim jimmy | jan: honza jenda | jean-baptiste: jb | jesus: chus | joaquin: quino ximo chimo | johann: hans hannes | john: jack | jonas: jonah | jose: pepe chepe pepito
josef: sepp peppi jupp pepik | joseph: joe sepp | karl: kalle | katharina: katja kathe trina | klara: klarchen | konstantin: kostya | lawrence: larry | leandro: leo | leopold: poldi
lorenz: lenz | ludovic: ludwik | ludwig: lutz wiggerl lui | luigi: gigi gino | manuel: manolo lolo | marcelo: marcelino chelo | margaret: peggy maggie meg madge greta daisy marge
margarete: gretel | marguerite: margot | marie: manon | mary: polly molly | mathilde: tilda | matteo: teo | michael: mike mick | mikhail: misha mischa miska | nicolas: colin
nikolai: kolya klaus nolo | noemie: emi mimi | norbert: bertl | octavio: tavo | ottavio: otto | philippa: pippa pip | pierre: perrin pierrot | pilar: piluca | pyotr: petya
quirin: quirino | richard: dick rick | robert: bob bobby | rosalia: lia | rosario: charo | sarah: sally | sigrid: siri | silvio: silvano | stanislaw: staszek | tadeo: tedi
teresa: tessa resi | theodor: ted teddy | thomas: tom tommy tomas thos | ulrike: uli ulla | ursula: ursel uschi | veronika: vroni | viktor: vic vitya | vincenzo: cencio
vladimir: volodya vova | walter: wat | wenzel: vaclav | william: bill wm billy | wojciech: wojtek | zacharias: zack
"""
# ---------------------------------------------------------------- end of fixed values
NICKNAMES: dict[str, set[str]] = {}
for _entry in re.split(r"[|\n]", NICKNAMES_TEXT.strip()):
    _name, _short = _entry.split(":")
    for _w in _short.split():
        NICKNAMES.setdefault(_w, set()).add(_name.strip())


@lru_cache(40_000)
def familiar(t: str, u: str) -> bool:
    """Whether ``t`` is by its form a familiar name of ``u``: its beginning (Zach), its end
    (Nando), or its beginning with y, ie or i, a consonant doubled or not (Rafi, Danny)."""
    if len(t) >= 3 and t != u and u.startswith(t):
        return True
    if len(t) >= 4 and len(u) - len(t) >= 2 and u.endswith(t):
        return True
    m = re.fullmatch(r"(.{3,}?)(?:y|ie|i)", t)
    return bool(m) and t != u and (u.startswith(m.group(1)) or len(m.group(1)) > 3 and m.group(1)[-1] == m.group(1)[-2] and u.startswith(m.group(1)[:-1]))


@lru_cache(40_000)
def skeleton(token: str) -> str:
    """A spelling that a Latin name and its Cyrillic transliteration share."""
    if is_cyrillic(token):
        t = "".join(CYRILLIC.get(c, c) for c in token.lower()).replace("_", "")
        return re.sub(r"(.)\1", r"\1", t.replace("ks", "x").replace("S", "s"))
    t = token
    for a, b in (("sch", "s"), ("sh", "s"), ("ch", "h"), ("qu", "kv"), ("ck", "k"), ("c", "k"), ("q", "k"), ("w", "v"), ("ks", "x")):
        t = t.replace(a, b)
    return re.sub(r"(.)\1", r"\1", t)


@dataclass
class Name:
    """kind: person, anonymous, traditional or nobody. tokens: folded words in the
    written order without particles; short: those that are initials or cut words
    (a full stop follows, or one letter). surname: how many tokens at the *end* of
    ``tokens`` are known to be the surname (0: order unknown). gen: 1 or 2 for
    elder and younger, else 0."""

    kind: str
    tokens: list[str] = field(default_factory=list)
    short: list[bool] = field(default_factory=list)
    surname: int = 0
    gen: int = 0
    cyr: bool = False
    m_title: bool = False

    @property
    def key(self) -> str:
        """Equal for spellings that differ in order, case, accents and decoration."""
        return ("c:" if self.cyr else "") + " ".join(sorted(t + ("." if s else "") for t, s in zip(self.tokens, self.short))) + f"|{self.gen}"

    @property
    def full(self) -> int:
        return sum(not s for s in self.short)


@lru_cache(40_000)
def _near(t: str, words: frozenset[str], least: int = 8) -> bool:
    """Whether ``t`` is one of ``words`` or a misspelling of a long one of them."""
    return t in words or len(t) >= least - 1 and any(len(w) >= least and w[0] == t[0] and abs(len(w) - len(t)) <= 2 and osa(t, w, 2) <= 2 for w in words)


_GEN_PAREN = re.compile(r"[(\[]\s*(?:the\s+|il\s+|le\s+|el\s+|der\s+|l')?(\w+\.?)\s*[)\]]")
_YEARS = re.compile(r"[(\[]?\s*(?:\*|†|b\.|d\.|fl\.|ca?\.|born|geb\.|um)?\s*\d{4}\s*(?:[-–—/]\s*(?:\d{2,4})?)?\s*[)\]]?")
_WORD = re.compile(r"[^\W_]+(?:['’`´][^\W\d_]+)*\.?", re.UNICODE)


def parse(raw: str | None) -> Name:
    """What a typed name says. Null, blank and meaningless text is kind ``nobody``."""
    if raw is None:
        return Name("nobody")
    s = repair(raw).replace(" ", " ").strip()
    if not re.search(r"[^\W\d_]", s):
        return Name("nobody")
    low = fold(s)
    words = re.findall(r"[a-zЀ-ӿ]+", low)
    plain = [w for w in words if w not in PARTICLES]
    # unnamed and folk authorship, unless a person stands beside an "ed. anon."
    def all_in(extra):
        return all(w in UNNAMED or w in FOLK or w in extra or len(w) <= 2 or _near(w, UNNAMED) or _near(w, FOLK) for w in plain)
    has_folk = any(w in FOLK or _near(w, FOLK, 9) for w in plain)
    has_anon = any(w in UNNAMED or _near(w, UNNAMED, 8) for w in plain)
    if has_folk and all_in(FOLK_WITH | UNNAMED_WITH | NOTES):
        return Name("traditional")
    if has_anon and not {"file", "fichier", "datei", "title"} & set(plain) and all_in(UNNAMED_WITH | NOTES | ROLES):
        return Name("anonymous")
    if all(w in NOISE or len(w) < 2 or w in ROLES or w in NOTES for w in words) or re.search(r"#(?:ref|n/a|name|value)", low) or re.fullmatch(r"\S+\.(?:mxl|xml|musicxml|pdf|mid|midi|txt)", low):
        return Name("nobody")

    gen = 0
    def see_gen(token: str) -> bool:
        nonlocal gen
        t = fold(token).strip(".")
        if t in ELDER or t in YOUNGER:
            gen = 1 if t in ELDER else 2
            return True
        return False

    def paren(m):
        return " " if see_gen(m.group(1)) else m.group(0)

    s = _GEN_PAREN.sub(paren, s)
    s = re.sub(r"[(\[{][^)\]}]*[)\]}]?", " ", _YEARS.sub(" ", s))
    s = re.sub(r"\s+[-–—/|]+\s+.*$", "", s) if re.search(r"[^\W\d_]{3}.*\s[-–—/|]+\s", s) else s
    # the younger and elder in words
    for pat, g in ((r"\b(?:the elder|il vecchio|el viejo|le p[eè]re|l['’]a[iî]n[eé]|der [aä]ltere|d\.\s?[ÄA]\.)", 1), (r"\b(?:the younger|il giovane|el joven|le fils|le jeune|der j[uü]ngere|d\.\s?J\.)", 2)):
        t = re.sub(pat, " ", s, flags=re.I)
        if t != s:
            gen, s = g, t
    s = s.strip(" \t?*;:,-–—/|<>\"“”«»„").lstrip(".")
    s = re.sub(r"(?<=[^\W\d_]{4})\.+$", "", s)
    slug = "_" in s or (s.islower() and "-" in s and " " not in s)
    natural = not slug
    if slug:
        # a slug's hyphens stand for spaces as well as for themselves
        s = s.replace("_", " ")
        if " " not in s:
            s = s.replace("-", " ")
    elif " " not in s and re.search(r"[a-zà-ÿ][A-ZÀ-Ý]", s) and not s.isupper() and len(re.findall(r"[A-ZÀ-Ý]", s)) <= len(s) // 3:
        s = re.sub(r"(?<=[a-zà-ÿ]{3})(von|van|della|del|de|da|di)(?=[A-ZÀ-ÝČŠŽ])", r" \1 ", s)
        s = re.sub(r"(?<=[a-zà-ÿčšžźńćł])(?=[A-ZÀ-ÝČŠŽ])", " ", s)
    parts = [p for p in s.split(",")]
    comma = False
    if len(parts) > 1:
        head = _WORD.findall(parts[0])
        tail = [w for w in _WORD.findall(parts[1])]
        tail_fold = [fold(w).strip(".") for w in tail]
        if not tail or tail_fold[0] in NOTES or tail_fold[0] in ROLES or any(t in ("arr", "arranged", "book", "transcr") for t in tail_fold):
            s = parts[0]
        elif head:
            if all(t in ELDER or t in YOUNGER for t in tail_fold):
                see_gen(tail_fold[-1])
                s = parts[0]
            else:
                comma = True
                s = parts[1]
                surname_text = parts[0]

    def words_of(text: str, leading: bool):
        """Words of one side, without titles, roles and what follows a note."""
        got: list[tuple[str, int, bool]] = []  # word; 2 with a full stop, 1 one letter; joined to the word before by a hyphen
        m_title = False
        for m in _WORD.finditer(text):
            w = delook(m.group())
            dot = w.endswith(".")
            w = w.rstrip(".")
            if re.search(r"[^\W\d_]", w) and re.search(r"\d", w) and not re.fullmatch(r"\d+(?:st|nd|rd|th|s)", w.lower()):
                w = w.translate(LEET)
            t = fold(w)
            hyphen = m.start() > 0 and text[m.start() - 1] == "-" and bool(got)
            if not hyphen:
                if t in NOTES and got and (dot or t not in ("for", "per", "from", "aus")):
                    break
                if t in NOTES and got:
                    break
                if t in NOTES or t in ROLES or (t.isdigit() and t not in ("1", "2")):
                    continue
                if t in TITLES and not got and leading:
                    continue
                if t == "m" and not got and leading and dot and re.match(r"\s*[^\W\d_]{3}", text[m.end() :]):
                    m_title = True
                    continue
                if t in PARTICLES and len(t) > 1:
                    continue
            got.append((t, 2 if dot else int(len(t) == 1), hyphen))
        return got, m_title

    got, m_title = words_of(s, True)
    surname = 0
    if comma:
        sur, _ = words_of(surname_text, False)
        if not sur:
            comma = False
        else:
            # a marker of generation may stand on either side
            while len(sur) > 1 and (sur[-1][0] in YOUNGER or sur[-1][0] in ELDER):
                see_gen(sur.pop()[0])
            while got and not got[-1][2] and (got[-1][0] in ("ii", "1", "2", "jr", "sr", "junior", "senior", "elder", "younger") or got[-1][0] == "i" and len(got) > 1 and got[-1][1] == 1):
                see_gen(got.pop()[0])
            while got and got[0][0] in TITLES:
                got.pop(0)
            got = got + sur
            surname = len(sur)
    if not comma:
        def is_gen(w, n):
            t, short, hyphen = w
            if hyphen:
                return False
            if t in ("и", "ии"):
                return True
            if t == "i":
                return n > 2 and short == 1
            return t in ("ii", "1", "2", "jr", "jnr", "sr", "junior", "senior", "elder", "younger", "vecchio", "giovane", "viejo", "joven", "pere", "fils")
        while len(got) > 1 and is_gen(got[-1], len(got)):
            t = got.pop()[0]
            see_gen({"и": "i", "ии": "ii"}.get(t, t))
        if natural and got:
            if got[-1][1] and len(got) > 1:  # "Surname A", "Surname A. B."
                k = len(got)
                while k and got[k - 1][1]:
                    k -= 1
                if k:
                    got = got[k:] + got[:k]
                    surname = k if all(h for _, _, h in got[-k + 1 :]) or k == 1 else 0
            if not surname:
                surname = 1
                while surname < len(got) and got[-surname][2]:
                    surname += 1
    got = [(t, short, h) for t, short, h in got if t]
    if not got or all(len(t) < 3 for t, _, _ in got):
        return Name("nobody")
    content = [t for t, short, _ in got if not short]
    if not content or all(t in NOISE for t in content):
        return Name("nobody")
    cyr = is_cyrillic("".join(content))
    return Name("person", [t for t, _, _ in got], [bool(x) for _, x, _ in got], min(surname, len(got)), gen, cyr, m_title)


def osa(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance (one edit: insert, delete, replace, swap
    neighbours), or ``most + 1`` where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(most + 1, max(len(a), len(b)))
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        ca = a[i - 1]
        for j in range(1, len(b) + 1):
            cb = b[j - 1]
            v = one[j - 1] + (ca != cb)
            if one[j] + 1 < v:
                v = one[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and two[j - 2] + 1 < v:
                v = two[j - 2] + 1
            row[j] = v
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(60_000)
def word_distance(a: str, b: str) -> int:
    """0 for the same word, 1 for one edit (swapped neighbours count as one), else
    9. A word in Cyrillic is compared by its skeleton; ``rn`` and ``m``, which
    scans confuse, count as the same."""
    if a == b:
        return 0
    if is_cyrillic(a) != is_cyrillic(b):
        a, b = skeleton(a), skeleton(b)
    elif ("rn" in a) != ("rn" in b) and a.replace("rn", "m") == b.replace("rn", "m"):
        return 0
    if min(len(a), len(b)) < 3:
        return 0 if a == b else 9
    d = osa(a, b, 1)
    return d if d <= 1 else 9


def within(x: str, y: str) -> bool:
    """Whether the letters of ``x`` stand in ``y`` in their order."""
    it = iter(y)
    return all(c in it for c in x)


@dataclass(frozen=True)
class Match:
    """How one spelling stands for a full name. cost: less is closer. given: given
    names that agree in whatever form. edits: letters wrong. partial: no given name
    is spelled out, so only the surname and perhaps initials speak for it."""

    cost: float
    given: int
    edits: int
    partial: bool


LACKING = 160  # cost of a word left out, in hundredths


def align(a: Name, b: Name, givens: frozenset[str] = frozenset()) -> Match | None:
    """``_align``, with a leading ``M.`` read as an initial or else as a title."""
    if a.m_title:
        m = _align(replace(a, tokens=["m", *a.tokens], short=[True, *a.short], m_title=False), b, givens)
        if m:
            return m
    return _align(a, b, givens)


def _align(a: Name, b: Name, givens: frozenset[str]) -> Match | None:
    """Whether ``a`` can be a spelling of ``b``, a well-formed full name whose
    surname is its last ``b.surname`` tokens; None if not.

    Words are assigned to words at least total cost, solved exactly by branch and
    bound however many words there are: a branch ends where even the least cost of the
    words left can't beat the best, or where the same words were used up before at no
    more cost. Initials and cut words may stand for
    given names only, a known given name (``givens``) never for another one, the
    first given name and the whole surname must be there, and at most one letter
    may be wrong in a word and two in all; in a name without a spelled-out given
    name none.
    """
    n, nb = len(a.tokens), len(b.tokens)
    if a.gen != b.gen or not n:
        return None
    first_sur = nb - b.surname
    known = a.surname and not a.cyr and (1 if a.surname < n else 2)
    rows: list[dict[int, tuple[int, int]]] = []  # by word of b: cost in hundredths, edits
    for i in range(n):
        t, short = a.tokens[i], a.short[i]
        row: dict[int, tuple[int, int]] = {}
        for j in range(nb):
            u, is_sur = b.tokens[j], j >= first_sur
            if known and not short and (i >= n - a.surname) != is_sur:
                continue
            if short or b.short[j]:
                if is_sur:
                    continue
                x, y = (t, u) if len(t) <= len(u) else (u, t)
                if y.startswith(x) or len(x) == 1 and skeleton(y)[:1] == skeleton(x)[:1] or len(x) > 1 and skeleton(y).startswith(skeleton(x)):
                    row[j] = (15, 0)
                elif u in NICKNAMES.get(t, ()) or t in NICKNAMES.get(u, ()) or any(v.startswith(x) for v in NICKNAMES.get(y, ())):
                    row[j] = (25, 0)
                elif len(x) > 1 and x[0] == y[0] and x[-1] == y[-1] and within(x, y):
                    row[j] = (25, 0)  # a contraction
                continue
            if t == u:
                row[j] = (0, 0)
            elif not is_sur and (u in NICKNAMES.get(t, ()) or t in NICKNAMES.get(u, ())):
                row[j] = (25, 0)
            elif not is_sur and t in givens and u in givens:
                continue
            elif not is_sur and (familiar(t, u) or familiar(u, t)):
                row[j] = (30, 0)
            else:
                d = word_distance(t, u)
                if d < 9:
                    row[j] = (100 * d, d)
        rows.append(row)
    # a middle name that b lacks
    skips = [n - (a.surname or 1) > 1 and i < n - a.surname and not (a.surname and i == 0) for i in range(n)]
    choices = [sorted(row.items(), key=lambda x: x[1]) for row in rows]
    if not all(c or skip for c, skip in zip(choices, skips)):
        return None
    surname = sum(1 << j for j in range(first_sur, nb))
    # of the words from i on: the sum and the largest of their least costs, how many may
    # be left out, and how many may be part of the surname
    least, most, spare, able = ([0] * (n + 1) for _ in range(4))
    for i in reversed(range(n)):
        c = choices[i][0][1][0] if choices[i] else LACKING
        least[i], most[i] = least[i + 1] + c, max(most[i + 1], c)
        spare[i], able[i] = spare[i + 1] + skips[i], able[i + 1] + any(j >= first_sur for j in rows[i])
    best = None
    seen: dict[tuple[int, int, int], int] = {}
    stack: list[tuple[int, int, int, int, tuple]] = [(0, 0, 0, 0, ())]
    while stack:
        i, used, total, edits, pairs = stack.pop()
        # more words than are free: so many are left out
        out = max(0, n - i - (nb - used.bit_count()))
        if out > spare[i] or (surname & ~used).bit_count() > able[i] or best and total + least[i] + out * (LACKING - most[i]) >= best[0]:
            continue
        if i == n:
            best = total, used, edits, pairs
            continue
        if any(seen.get((i, used, e), total + 1) <= total for e in range(edits + 1)):
            continue
        seen[i, used, edits] = total
        if skips[i]:  # last of all, as the stack is emptied from its end
            stack.append((i + 1, used, total + LACKING, edits, pairs))
        for j, (c, e) in reversed(choices[i]):
            if not used >> j & 1 and edits + e <= 2:
                stack.append((i + 1, used | 1 << j, total + c, edits + e, (pairs, i, j)))
    if best is None:
        return None
    total, used, edits, chain = best
    pairs = []
    while chain:
        chain, i, j = chain
        pairs.append((i, j))
    given = sum(j < first_sur for _, j in pairs)
    if len(pairs) < n and not given:
        return None
    if given and not used & 1:
        return None  # the first given name is never the one left out
    partial = not any(j < first_sur and not a.short[i] and not b.short[j] for i, j in pairs)
    if partial and edits:
        return None
    return Match((total + 30 * (first_sur - given) + 60 * (given == 0)) / 100, given, edits, partial)
