"""Surrogates for personal data: keyed, type-consistent, distinct and the same wherever an entity recurs. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Titles and given names that mark a person, by gender and script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
          "n": ["Dr", "Prof"]}
GIVEN = {("f", "latin"): ["Alice", "Barbara", "Charlotte", "Deborah", "Elizabeth", "Francesca", "Gabriela", "Hannah", "Isabella", "Jennifer",
                          "Katharina", "Linda", "Margaret", "Natalie", "Patricia", "Rebecca", "Sophia", "Susan", "Victoria", "Mary"],
         ("m", "latin"): ["Andrew", "Benjamin", "Christopher", "Daniel", "Edward", "Francisco", "George", "Heinrich", "James", "John",
                          "Kenneth", "Michael", "Nicholas", "Patrick", "Philippe", "Richard", "Robert", "Sebastian", "Thomas", "William"],
         ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Екатерина", "Светлана", "Юлия"],
         ("m", "cyrillic"): ["Александр", "Дмитрий", "Сергей", "Иван", "Михаил", "Николай", "Алексей", "Владимир", "Павел", "Андрей"]}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ko", "li", "mo", "pa", "ze"],
             "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "ко", "ли", "мо", "па", "зе"]}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
#: What a group of digits after another one may not start: an IPv4 address, or an e-mail address.
_OWN = r"(?!(?:\d{1,3}\.){3}\d)(?![\p{L}\p{N}_.+-]{1,64}+@)"
_CAP = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
#: A dot inside a secret, not one that ends a sentence.
_DOT = r"\.(?=[A-Za-z0-9_+/=-])"
#: What may stand between two digits of a phone number.
_GAP = r"(?:[ .-]|[ .-]?\(|\)[ .-]?)?"
#: Fixed value: country codes whose national numbers have one length. Others have 8 to 15 digits in all.
NATIONAL = {9: ["27", "31", "33", "34", "41", "48", "61", "351", "380", "420"], 10: ["1", "7", "52", "57", "63", "90", "91"], 8: ["45", "47", "65"]}
_PLANS = "|".join(rf"(?:{'|'.join(codes)})(?:[ .-]?\(0\))?(?:{_GAP}\d){{{n}}}" for n, codes in NATIONAL.items())
#: What is looked for, in the order in which a place is tried. Every pattern starts at a character that none of its own
#: runs can stand before, or is bounded, so a text is read in time proportional to its length.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": rf"(?<!\p{{L}})(?i:token|secret|password|passwd|api_?key|access_?key)\s{{0,2}}[=:]\s{{0,2}}[\"']?(?:[A-Za-z0-9_+/=-]|{_DOT}){{16,}}+"
              rf"|(?<![\p{{L}}\p{{N}}])(?:sk-|ghp_|AKIA|xox[bp]-)(?:[A-Za-z0-9_-]|{_DOT}){{16,}}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": rf"(?<![\p{{L}}\d])(?=(?:\d[ -]?){{12}}\d)\d++(?!\p{{L}})(?:[ -]{_OWN}\d++(?!\p{{L}}))*+",  # any digit groups: see pieces_of
    "phone": rf"(?<![\p{{L}}\d+])\+(?:{_PLANS})(?!\d)"
             rf"|(?<![\p{{L}}\d+])\+\d(?:{_GAP}\d){{7,14}}(?!\d)"
             r"|(?<![\p{L}\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,8}(?:[ .-]\d{2,8}){1,4}(?!\d)"
             r"|(?<![\p{L}\d])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\b\.? {_CAP}(?: {_CAP})?|(?:{_GIVEN}) {_CAP})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What is looked for in the digit groups beside a card.
BESIDE = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "card")

#: Every match holds a digit, @, = or :, one of these key starts, or a title or given name; a text without is not searched
#: by PATTERN. The look-ahead lets a position go by its character alone.
KEY_STARTS = ["sk-", "ghp_", "AKIA", "xox"]
_INITIALS = "".join(sorted({t[0] for t in f"{_TITLE}|{_GIVEN}".split("|")}))
NAME_GATE = rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})[. ]"


def may_hold(text: Column) -> Column:
    out = text.rlike("[0-9@=:]")
    for start in KEY_STARTS:
        out = out | text.contains(start)
    return out | text.rlike(NAME_GATE)


#: Fixed value: number ranges and lengths of the card schemes.
CARD = (r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}"
        r"|6(?:011|5\d\d|4[4-9]\d)\d{12}|35(?:2[89]|[3-8]\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11})$")

#: Fixed value: digit groups in which cards are printed.
GROUPINGS = ["4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3", "4-4-4-1"]

#: Rounds of collision checks before the operator gives up (each halves a name space that is half full).
MAX_ROUNDS = 64

#: Rows of a round's table that one task writes. Each file written costs processes of its own on some file systems.
TASK_ROWS = 100_000


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    each = F.transform(F.split(F.reverse(_digits(v)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(digits: Column) -> Column:
    """Whether digits are a card number: in a scheme's range, with a valid check digit."""
    return F.length(digits).between(13, 19) & digits.rlike(CARD) & luhn(digits)


def kind_of(match: Column) -> Column:
    """Kind of a match, null for none; ``card`` for digit groups, of which any, some or none may be cards (``pieces_of``)."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = match.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _apart(windows: Column) -> Column:
    """Of windows (first, short, last, ...) in their order those that overlap none taken before."""
    start = F.filter(windows, lambda w: F.lit(False))
    return F.aggregate(windows, start, lambda a, w: F.when(
        (F.size(a) == 0) | (w["first"] > F.try_element_at(a, F.lit(-1))["last"]), F.concat(a, F.array(w))).otherwise(a))


def _cards(run: Column, n: Column) -> Column:
    """Windows (first, short, last, odd) of whole groups that are card numbers, none overlapping another, by place.

    Where several do, one in a printed grouping (or one group, or all ``n`` groups) goes before others, then the first,
    then the longest. Windows are sought in the next 20 digits of each group, so long runs take linear time.
    """
    def window(near, i, j):
        inner = F.slice(near, F.lit(1), j)
        shape = F.array_join(F.transform(inner, lambda g: F.length(g).cast("string")), "-")
        odd = ~((j == 1) | ((i == 0) & (j == n)) | shape.isin(GROUPINGS))
        return F.struct((i + 1).alias("first"), (-j).alias("short"), (i + j).alias("last"), odd.alias("odd"), F.array_join(inner, "").alias("digits"))

    def from_group(ahead, i):
        return _let(F.split(ahead, "[ -]"), lambda near: F.filter(F.transform(
            F.sequence(F.lit(1), F.size(near)), lambda j: window(near, i, j)), lambda w: is_card(w["digits"])))

    nexts = F.regexp_extract_all(run, F.lit(r"(?<!\d)(?=((?:[ -]?\d){13,20}))\d++"), F.lit(1))
    every = F.flatten(F.transform(nexts, from_group))

    def chosen(ws):
        plain = _apart(F.filter(ws, lambda w: ~w["odd"]))
        return _let(plain, lambda ps: F.sort_array(F.concat(ps, _apart(F.filter(ws, lambda w: w["odd"] & ~F.exists(
            ps, lambda q: (q["first"] <= w["last"]) & (w["first"] <= q["last"])))))))
    return _let(F.sort_array(every), chosen)


def _beside(text: Column) -> Column:
    """Pieces (m, kind) of the digit groups between cards: what the other patterns find, and the rest."""
    none = F.lit(None).cast("string")
    zipped = F.arrays_zip(F.split(text, BESIDE, -1).alias("a"), F.regexp_extract_all(text, F.lit(BESIDE), F.lit(0)).alias("b"))
    return F.flatten(F.transform(zipped, lambda z: F.array(
        F.struct(z["a"].alias("m"), none.alias("kind")),
        F.struct(F.coalesce(z["b"], F.lit("")).alias("m"), F.when(z["b"].isNotNull(), kind_of(z["b"])).alias("kind")))))


def _split_groups(run: Column) -> Column:
    """Pieces (m, kind) of digit groups one blank or hyphen apart: the cards among them, and what stands beside."""
    def cut(groups):
        def length(to):  # of the first groups and the separators after them
            return F.aggregate(F.slice(groups, F.lit(1), to), F.lit(0), lambda a, g: a + F.length(g) + 1)

        def pieces(cards):
            ends = F.transform(cards, lambda w: F.struct(length(w["first"] - 1).alias("a"), (length(w["last"]) - 1).alias("b")))
            return _let(ends, lambda es: F.concat(
                F.flatten(F.transform(es, lambda e, k: F.concat(
                    _let(F.when(k > 0, F.try_element_at(es, k)["b"]).otherwise(F.lit(0)), lambda at: _beside(F.substr(run, at + 1, e["a"] - at))),
                    F.array(F.struct(F.substr(run, e["a"] + 1, e["b"] - e["a"]).alias("m"), F.lit("card").alias("kind")))))),
                _beside(F.substr(run, F.coalesce(F.try_element_at(es, F.lit(-1))["b"], F.lit(0)) + 1))))
        return _let(_cards(run, F.size(groups)), pieces)
    return _let(F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)), cut)


def pieces_of(match: Column) -> Column:
    """A match as pieces (m, kind) that make it up; kind is null for a piece that is no entity."""
    return _let(kind_of(match), lambda kind: F.when(kind == "card", _split_groups(match)).otherwise(
        F.array(F.struct(match.alias("m"), kind.alias("kind")))))


def _secret_head(match: Column) -> Column:
    """What stands before the secret itself: the label, or the fixed start of a known key."""
    return F.regexp_extract(match, r"^((?:[A-Za-z_]+\s{0,2}[=:]\s{0,2}[\"']?)|sk-|ghp_|AKIA|xox[bp]-)", 1)


def units_of(match: Column, kind: Column) -> Column:
    """Entities of a match as ``kind:canonical`` texts; spellings of one entity share them.

    Emails are lower-cased; phone and other numbers are their digits (a phone its last ten, so that a country code or
    other spacing makes no difference); a person's name is its words apart from titles and known given names.
    """
    digits = _digits(match)
    words = F.filter(F.split(F.regexp_replace(match, r"\.", ""), " "), lambda w: ~w.isin(
        [t for ts in TITLES.values() for t in ts] + [n for ns in GIVEN.values() for n in ns]))
    one = (F.when(kind == "email", F.lower(match)).when(kind == "ip", match)
           .when(kind == "phone", F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits))
           .when(kind.isin("ssn", "card"), digits).when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
           .when(kind == "secret", F.substr(match, F.length(_secret_head(match)) + 1)))
    return F.when(kind == "name", F.transform(words, lambda w: F.concat(F.lit("name:"), w))).when(
        kind.isNotNull(), F.array(F.concat(kind, F.lit(":"), one))).otherwise(F.array().cast("array<string>"))


def _draw(n: int, *of: Column) -> Column:
    """A keyed number from 0 to n - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *of), 256), 1, 12), 16, 10).cast("long") % n


def _pick(chars: str, *of: Column) -> Column:
    return F.substr(F.lit(chars), (_draw(len(chars), *of) + 1).cast("int"), F.lit(1))


def _mapped_char(c: Column, digit: str, of: list[Column]) -> Column:
    return (F.when(c.rlike("^[0-9]$"), _pick(digit, *of))
            .when(c.rlike("^[a-z]$"), _pick("abcdefghijklmnopqrstuvwxyz", *of))
            .when(c.rlike("^[A-Z]$"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", *of))
            .when(c.rlike(r"^\p{IsCyrillic}$"), _pick("абвгдежзиклмнопрстуф", *of))
            .when(c.rlike(r"^\p{L}$"), _pick("abcdefghijklmnopqrstuvwxyz", *of)).otherwise(c))


#: Characters from which a unit's characters are drawn by its hash, so that the time is linear in its length.
LONG = 600


def surrogate(unit: Column, key: str, attempt: Column) -> Column:
    """Keyed replacement of a unit's canonical text: of its kind, script, length and character classes."""
    kind, text = F.substring_index(unit, ":", 1), F.expr("substring({0}, instr({0}, ':') + 1)".format("unit"))
    base = [F.lit(key), unit, attempt.cast("string")]
    seed = F.when(F.length(unit) > LONG, F.sha2(unit, 256)).otherwise(unit)
    hexadecimal = text.rlike("^[0-9a-f]+$")

    def mapped(t: Column, digit: str = "0123456789") -> Column:
        return _let(seed, lambda of: F.array_join(F.transform(F.split(t, ""), lambda c, i: _mapped_char(c, digit, [F.lit(key), of, attempt.cast("string"), i.cast("string")])), ""))

    top = F.regexp_extract(text, r"\.[^.]*$", 0)
    inner = mapped(F.expr("substring(unit, instr(unit, ':') + 1, length(unit) - instr(unit, ':') - 1)"))  # all but the check digit
    kept = F.when(F.substring(text, 1, 1) == "4", F.lit(1)).otherwise(F.lit(4))  # the scheme's range stays
    body = F.concat(F.substr(text, F.lit(1), kept), F.substr(inner, kept + 1))
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0)))), F.lit(0), lambda a, x: a + x)
    octets = [F.lit(1) + _draw(223, *base, F.lit("0"))] + [_draw(256, *base, F.lit(str(i))) for i in (1, 2, 3)]
    script = F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))

    def family(s: str) -> Column:
        parts = [F.element_at(F.array(*(F.lit(x) for x in SYLLABLES[s])), (_draw(len(SYLLABLES[s]), *base, F.lit(str(i))) + 1).cast("int")) for i in range(5)]
        return F.initcap(F.concat(*parts))

    return (F.when(kind == "email", F.concat(mapped(F.expr("substring(unit, instr(unit, ':') + 1, length(unit) - instr(unit, ':') - length(regexp_extract(unit, '[.][^.]*$', 0)))")), top))
            .when(kind == "ip", F.concat_ws(".", *(o.cast("string") for o in octets)))
            .when(kind == "card", F.concat(body, ((10 - total % 10) % 10).cast("string")))
            .when(kind == "phone", F.when(F.length(text) == 10, F.concat(_pick("23456789", *base, F.lit("a")), F.substring(mapped(text), 2, 2),
                  F.when(F.substring(text, 4, 3) == "555", F.lit("555")).otherwise(F.concat(_pick("23456789", *base, F.lit("b")), F.substring(mapped(text), 5, 2))),
                  F.substring(mapped(text), 7, 4))).otherwise(mapped(text)))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(mapped(text), 2, 8)))
            .when(kind == "iban", F.concat(F.substring(text, 1, 2), F.substring(mapped(text), 3, 60)))
            .when(kind == "name", F.when(script == "cyrillic", family("cyrillic")).otherwise(family("latin")))
            .otherwise(F.when(hexadecimal, _let(seed, lambda of: mapped_hex(text, [F.lit(key), of, attempt.cast("string")]))).otherwise(mapped(text))))


def mapped_hex(text: Column, base: list[Column]) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _pick("0123456789abcdef", *base, i.cast("string"))), "")


def assign(units: DataFrame, key: str) -> DataFrame:
    """``unit``, ``surrogate`` for distinct units: no two units of a kind share one, and none is another's original.

    Each round draws for the units still open and checks the draws against each other, against what earlier rounds
    fixed and against all originals; of those that draw alike the first keeps it. A round is one table of its draws with
    the verdict on each, written by as many tasks as its rows ask for, however many partitions the checks take.
    """
    tasks = 1 + units.count() // TASK_ROWS
    originals = units.select(F.substring_index("unit", ":", 1).alias("kind"), F.expr("substring(unit, instr(unit, ':') + 1)").alias("surrogate"))
    todo, done = units, None
    for attempt in range(MAX_ROUNDS):
        drawn = todo.select("unit", F.substring_index("unit", ":", 1).alias("kind"), surrogate(F.col("unit"), key, F.lit(attempt)).alias("surrogate"))
        good = F.col("unit") == F.min("unit").over(Window.partitionBy("kind", "surrogate"))
        judged = drawn.withColumn("good", good).join(originals.withColumn("original", F.lit(True)), ["kind", "surrogate"], "left")
        good = F.col("good") & F.col("original").isNull()
        if done is not None:
            judged = judged.join(done.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"], "left")
            good = good & F.col("used").isNull()
        judged = materialize(judged.select("unit", "kind", "surrogate", good.alias("good")).repartition(tasks), "pii-round")
        fixed = judged.where("good").drop("good")
        done = fixed if done is None else done.union(fixed)
        todo = judged.where(~F.col("good")).select("unit")
        if todo.isEmpty():
            return done.select("unit", "surrogate")
    raise ValueError(f"no distinct surrogates for all entities after {MAX_ROUNDS} rounds")


def _pour(surface: Column, filled: Column, alike: str, skip: Column | None = None) -> Column:
    """``surface`` with its characters of class ``alike`` taken from ``filled`` in turn, after ``skip`` of them kept."""
    skip = F.lit(0) if skip is None else skip
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(a, c):
        counted = c.rlike(alike)
        put = F.when(counted & (a["k"] >= skip), F.substr(filled, a["k"] - skip + 1, F.lit(1))).otherwise(c)
        put = F.when(c.rlike(r"^\p{Lu}$"), F.upper(put)).otherwise(put)
        return F.struct(F.concat(a["out"], put).alias("out"), (a["k"] + F.when(counted, F.lit(1)).otherwise(F.lit(0))).alias("k"))
    return F.aggregate(F.split(surface, ""), start, step)["out"]


def _other_given(word: Column, key: str) -> Column:
    """Another given name of the same gender and script: a keyed rotation of the list, so distinct names stay distinct."""
    import hashlib
    pairs = []
    for (gender, script), names in GIVEN.items():
        shift = 1 + int(hashlib.sha256(f"{key}|{gender}|{script}".encode()).hexdigest(), 16) % (len(names) - 1)
        pairs += [x for i, n in enumerate(names) for x in (F.lit(n), F.lit(names[(i + shift) % len(names)]))]
    return F.create_map(*pairs)[word]


def rendered(match: Column, kind: Column, units: Column, mapping: Column, key: str) -> Column:
    """The replacement of a match in its own format; a match of no kind stays."""
    new = F.try_element_at(mapping, F.try_element_at(units, F.lit(1)))
    extra = F.greatest(F.length(_digits(match)) - 10, F.lit(0))
    titles = [t for ts in TITLES.values() for t in ts]

    def word(w):
        bare = F.regexp_replace(w, r"\.$", "")
        return F.when(bare.isin(titles), w).otherwise(F.coalesce(_other_given(bare, key), F.try_element_at(mapping, F.concat(F.lit("name:"), bare)), w))

    return (F.when(kind.isNull(), match).when(kind == "name", F.array_join(F.transform(F.split(match, " "), word), " "))
            .when(new.isNull(), match).when(kind == "email", _pour(match, new, r"^[\s\S]$")).when(kind == "ip", new)
            .when(kind == "phone", _pour(match, new, "^[0-9]$", extra)).when(kind == "iban", _pour(match, new, "^[A-Z0-9]$"))
            .when(kind == "secret", F.concat(_secret_head(match), new)).otherwise(_pour(match, new, "^[0-9]$")))


def replace_entities(docs: DataFrame, key: str = "surrogates-1", text: str = "text", count_into: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced; the columns of ``docs``, and ``count_into`` (entities replaced).

    Detected: e-mail addresses, labelled secrets and known key formats, IPv4 addresses, phone numbers, social security
    numbers, payment cards (in a scheme's range, with a valid check digit), IBANs, and people named by a title or a known given name. A
    replacement depends only on the entity and ``key``, so an entity has one throughout the corpus; no two entities of
    a kind share one and none is an original of the corpus (known given names rotate within their list instead).
    Where a column ``n_chars`` holds the text's length it is brought up to date. Null and empty texts and texts without
    entities pass unchanged; all rows stay, repeated ones too; other columns are untouched whatever their names.

    Only texts with entities meet the table of surrogates, by the text's hash; the rest is one scan.
    """
    p = "pii_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    found, by = f"{p}found", f"{p}by"
    scanned = docs.withColumn(found, F.when(
        may_hold(F.col(text)), F.regexp_extract_all(F.col(text).cast("string"), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def parsed(matches: Column) -> Column:
        return F.transform(matches, lambda m: F.transform(pieces_of(m), lambda s: F.struct(
            s["m"].alias("m"), s["kind"].alias("kind"), units_of(s["m"], s["kind"]).alias("units"))))

    hits = scanned.where(F.size(found) > 0).select(F.sha2(F.col(text), 256).alias(by), F.col(found).alias(found))
    # The scan's own tasks write the units of each text; texts that recur are made distinct when it is read.
    each = materialize(hits.select(by, F.explode(F.array_distinct(F.flatten(F.transform(F.flatten(parsed(F.col(found))), lambda s: s["units"])))).alias("unit")), "pii-units")
    table = assign(each.select("unit").distinct(), key)
    maps = (each.distinct().join(table, "unit").groupBy(by).agg(F.map_from_entries(F.collect_set(F.struct("unit", "surrogate"))).alias(f"{p}map")))
    plain = scanned.where(F.size(found) == 0)
    with_maps = (scanned.where(F.size(found) > 0).withColumn(by, F.sha2(F.col(text), 256)).join(maps, by, "left")
                 .withColumn(f"{p}map", F.coalesce(F.col(f"{p}map"), F.create_map().cast("map<string,string>"))))
    parts = F.split(F.col(text), PATTERN, -1)
    new = F.transform(parsed(F.col(found)), lambda pieces: F.array_join(F.transform(
        pieces, lambda s: rendered(s["m"], s["kind"], s["units"], F.col(f"{p}map"), key)), ""))
    whole = F.array_join(F.transform(F.arrays_zip(parts.alias("a"), new.alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    counted = F.size(F.filter(F.flatten(F.transform(F.col(found), pieces_of)), lambda s: s["kind"].isNotNull())).cast("long")
    with_maps = with_maps.withColumn(f"{p}new", whole).withColumn(f"{p}n", counted)

    def out(df: DataFrame, changed: bool) -> DataFrame:
        cols = []
        for f in docs.schema.fields:
            c = F.col(f"`{f.name}`")
            if changed and f.name == text:
                c = F.col(f"{p}new")
            elif changed and f.name == "n_chars":
                c = F.when(c == F.length(text), F.length(f"{p}new")).otherwise(c).cast(f.dataType)
            cols.append(c.alias(f.name))
        if count_into:
            cols.append((F.col(f"{p}n") if changed else F.lit(0).cast("long")).alias(count_into))
        return df.select(cols)

    return out(plain, False).union(out(with_maps, True))
