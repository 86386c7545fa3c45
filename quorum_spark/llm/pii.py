"""Personal data by regular expressions, checksums and context words, in DataFrame functions alone.

Patterns propose spans from left to right, without overlap within a kind. Checks confirm or drop them: parts of addresses
up to 255, Luhn for card numbers, mod-97 for bank account numbers, digit counts for phone numbers. A dropped proposal is
not tried again from another place, but for bank account numbers: these are proposed at every place where one can start,
have the length of their country (codes without one: as long as the run of capitals and digits goes), and of confirmed
ones that overlap the first counts. Words such as "card" or "iban" in the CONTEXT characters around a span raise its score;
kinds that go beyond the base ones (iban, secret) are kept from a score of LEAST. Base spans are always kept.

Proposals are marked in the text with two control characters, and positions follow from running sums of the lengths between
the marks, so a text is scanned once for each kind. A proposal that may overlap the next is marked as a copy before its
place. Running sums go through CHUNK numbers at a time, and redaction cuts fixed-width code points, so both take time in
proportion to the text and its spans. Patterns are written without backtracking: a run is tried from its first character, or
from where the last match ended, and from nowhere else.

Null counts as empty text, empty texts have no spans. Positions are in code points, ends exclusive. Rows are answered one by
one, so repeated rows and extra columns don't matter; spans of one start are in the order of KINDS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
_LOCAL = "[A-Za-z0-9._%+-]"
#: Countries of each length of a bank account number, spaces not counted: the registry's and those in use without an entry.
COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_FIXED = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in COUNTRIES.items())
_OTHER = rf"(?!{'|'.join(' '.join(COUNTRIES.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_FIXED}|{_OTHER})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])",
}
#: Kinds proposed at every place, whether or not an earlier proposal covers it.
OVERLAPPING = ("iban",)
#: What a text must hold for a kind's pattern to be worth trying.
NEEDED = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[0-9]"}
#: What a span of each kind scores by itself, and the words nearby that add NEAR to it.
ALONE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.4}
WORDS = {
    "email": r"e-?mail|contact|correo|courriel|kontakt",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": r"card|visa|credit|tarjeta|carte|karte",
    "phone": r"phone|call|tel\b|mobile|tel[eé]fono|t[eé]l[eé]phone|telefon",
    "iban": r"iban|account|bank|cuenta|compte|konto",
    "secret": r"token|key|secret|password|apikey",
}
NEAR, LEAST, CONTEXT = 0.2, 0.5, 40
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_OPEN, _CLOSE = "\x01", "\x02"
#: Numbers that a running sum goes through before it begins another array.
CHUNK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit sum, every second digit from the right doubled, is a multiple of ten."""
    every = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(every, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)
    return rest == 1


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(F.when(F.length(digits).between(14, 19), digits).otherwise(""))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Fa-f]")
    return F.lit(True)


def _score(kind: str, around: Column) -> Column:
    return F.lit(ALONE[kind]) + F.when(around.rlike("(?i)" + WORDS[kind]), NEAR).otherwise(0.0)


def cut(text: Column, kind: str) -> Column:
    """The text up to the first proposal, and then each proposal with the text up to the next, parted by a mark."""
    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "￾￾")
    proposal = f"(?=({PATTERNS[kind]}))" if kind in OVERLAPPING else f"({PATTERNS[kind]})"
    marked = F.when(clean.rlike(NEEDED[kind]), F.regexp_replace(clean, proposal, f"{_OPEN}$1{_CLOSE}")).otherwise(clean)
    return F.split(marked, _OPEN)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array in arrays of up to CHUNK."""
    n = F.ceil(F.size(values) / CHUNK).cast("int")
    return F.when(n == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK))))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's whole numbers what all before it make together, from 0; step adds one to the others."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda xs, of: F.aggregate(xs, zero, lambda acc, x: F.struct(step(acc.at, of(x)).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")))
    own = let(values, lambda v: F.transform(_chunks(v), lambda c: fold(c, lambda x: x)))
    return let(own, lambda cs: F.flatten(F.zip_with(cs, fold(cs, lambda c: c.at).out, lambda c, before: F.transform(c.out, lambda x: step(before, x)))))


def _first_come(found: Column) -> Column:
    """Of spans in order those that begin after the last one that was taken."""
    none = F.array().cast("array<boolean>")

    def take(acc: Column, s: Column) -> Column:
        ok = s.start >= acc.at
        return F.struct(F.when(ok, s.end).otherwise(acc.at).alias("at"), F.concat(acc.taken, F.array(ok)).alias("taken"))

    def chunk(acc: Column, c: Column) -> Column:
        last = F.aggregate(c, F.struct(acc.at.alias("at"), none.alias("taken")), take)
        return let(last, lambda r: F.struct(r.at.alias("at"), F.concat(acc.taken, F.array(r.taken)).alias("taken")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<boolean>>").alias("taken"))
    taken = lambda v: F.aggregate(_chunks(v), first, chunk, lambda acc: F.flatten(acc.taken))
    return let(found, lambda v: F.transform(F.filter(F.arrays_zip(v.alias("s"), taken(v).alias("ok")), lambda z: z["ok"]), lambda z: z["s"]))


def spans(parts: Column, kind: str) -> Column:
    """Confirmed spans of a kind, in order: array of (start, rank, end, kind, score). parts: as cut makes them."""
    rank, again = KINDS.index(kind), kind in OVERLAPPING

    def add(z: Column) -> Column:
        match, rest = F.substring_index(z["x"], _CLOSE, 1), F.substring_index(z["x"], _CLOSE, -1)
        after = rest.substr(F.length(match) + 1, F.lit(CONTEXT)) if again else F.left(rest, F.lit(CONTEXT))
        around = F.concat(F.right(F.substring_index(z["y"], _CLOSE, -1), F.lit(CONTEXT)), F.lit(" "), after)
        return F.struct(z["at"].alias("start"), (z["at"] + F.length(match)).alias("end"), match.alias("match"), around.alias("around"))

    def found(p: Column) -> Column:
        size = lambda x, i: F.length(F.substring_index(x, _CLOSE, -1)) if again else F.length(x) - F.when(i > 0, 1).otherwise(0)
        at = running(F.transform(p, size), lambda a, b: a + b)
        some = lambda c, first: F.slice(c, first, F.greatest(F.size(p) - 1, F.lit(0)))
        return F.transform(F.arrays_zip(some(p, 2).alias("x"), some(p, 1).alias("y"), some(at, 2).alias("at")), add)

    valid = F.filter(let(parts, found), lambda s: _valid(kind, s.match))
    if again:
        valid = _first_come(valid)
    out = F.transform(
        valid,
        lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind"), _score(kind, s.around).alias("score")),
    )
    out = out if kind in BASE else F.filter(out, lambda s: s.score >= LEAST)
    return F.when(F.size(parts) > 1, out).otherwise(F.array().cast(SPANS))


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with one more column for each kind, its spans."""
    parts = docs.withColumns({f"_parts_{k}": cut(F.col("text"), k) for k in KINDS})
    return parts.select(*docs.columns, *[spans(F.col(f"_parts_{k}"), k).alias(f"_{k}") for k in KINDS])


def _joined(*kinds: str) -> Column:
    every = F.array_sort(F.concat(*[F.col(f"_{k}") for k in kinds]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    found = find_spans(docs.select("doc_id", "text"))
    every = F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS]))
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(*BASE).cast("binary"), 256).alias("base_sha256"),
        _joined(*KINDS).alias("spans"),
        F.array_join(F.transform(every, lambda s: F.format_number(s.score, 1)), ",").alias("scores"),
    )


def _cut_out(text: Column, found: Column) -> Column:
    """text with spans, in order of their starts, replaced by their kinds. Spans that overlap one before them go with it.

    Code points are four bytes wide here, so a piece is cut without going through what is before it. The letter in front of
    each piece keeps a mark of byte order from being taken for one.
    """
    point = lambda wide, a, n: F.decode(F.concat(F.encode(F.lit("x"), "UTF-32"), F.substring(wide, a * 4 + 1, n * 4)), "UTF-32").substr(F.lit(2), n)

    def pieces(s: Column) -> Column:
        last = F.array_max(F.transform(s["found"], lambda x: x.end))
        ends = running(F.transform(s["found"], lambda x: x.end), lambda a, b: F.greatest(a, b))
        put = lambda z: F.when(z["x"].start >= z["at"], F.concat(point(s["wide"], z["at"], z["x"].start - z["at"]), F.lit("<"), F.upper(z["x"].kind), F.lit(">"))).otherwise(F.lit(""))
        before = F.array_join(F.transform(F.arrays_zip(s["found"].alias("x"), ends.alias("at")), put), "")
        return F.concat(before, point(s["wide"], last, F.greatest((F.octet_length(s["wide"]) / 4).cast("int") - last, F.lit(0))))

    return let(F.struct(F.encode(text, "UTF-32").alias("wide"), found.alias("found")), pieces)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets, and n_chars to match. Of overlapping spans the earliest counts, and covers the others."""
    found = find_spans(docs).withColumn("_spans", F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    text = F.col("text")
    new = F.when(F.size("_spans") > 0, _cut_out(text, F.col("_spans"))).otherwise(text)
    cols = [new.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    out = found.select(*cols)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
