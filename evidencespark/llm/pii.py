"""Personal data by patterns, checksums and context words, in DataFrame operations only.

A pattern proposes spans; Luhn (cards), mod-97 (IBANs) and value ranges confirm them; words near a span
raise its score. The four base kinds (email, ip, card, phone) are reported whenever their check passes;
the further kinds (iban, national_id) also need a score of MIN_SCORE, which a passed checksum gives and
a bare number gets only from its context.

To find where the matches of a pattern lie, each is put between two marks (a control character that no pattern
matches, after any in the text itself has been replaced by another) and the text is split at the marks:
every second piece is a match, and the lengths of the pieces give its place in code points. The patterns
are possessive and start either where the last match ended or at a run's first character, which finds the
same matches as the plain forms but takes time in proportion to the text, also on runs without a match.

Defined results: null text is empty; empty text has no spans; overlapping spans of two kinds are both
reported, and redaction replaces their union once; repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
MIN_SCORE = 0.5
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24
#: Elements of a block of a scan, code points of a chunk of text: they set the speed on texts with many matches, not results.
SCAN_BLOCK, CHUNK = 64, 1024

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap conditions that every text with a match meets.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "national_id": r"-[0-9]{2}-"}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel)",
    "ip": r"(?i)\b(?:ip|address|host|server|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|m[oó]vil)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
    "national_id": r"(?i)\b(?:ssn|social security|national id|tax id|id no)",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.2}
CONTEXT_GAIN = 0.4


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(value > 9, value - 9).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    plain = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The check of a kind; True for a kind without one."""
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "national_id":
        return ~match.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def _pieces(kind: str, text: Column) -> Column:
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    marked = F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}")
    return F.when(hint, F.split(marked, MARK, -1))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often use names it; both are arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running values of merge, after each element. An array can only be built by copying it, so values are merged by blocks of
    SCAN_BLOCK, and inside each block from what all blocks before it give: no array of all values is copied once an element."""
    def grown(acc: Column, v: Column) -> Column:
        return F.concat(acc, F.array(merge(F.element_at(acc, -1), v)))

    def cut(v: Column) -> Column:
        def run(first: Column, last: Column) -> Column:  # slice would copy all values each time
            return F.transform(F.sequence(first, last), lambda i: F.get(v, i))

        last = F.floor((F.size(v) - 1) / SCAN_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: run(b * SCAN_BLOCK, F.least(b * SCAN_BLOCK + SCAN_BLOCK, F.size(v)) - 1))
        return F.when(F.size(v) > 0, blocks)

    def inside(x: Column) -> Column:
        before = F.aggregate(F.transform(x, lambda block: F.aggregate(block, zero, merge)), F.array(zero), grown)
        return _bound(before, lambda b: F.flatten(F.transform(x, lambda block, i: F.slice(F.aggregate(block, F.array(F.get(b, i)), grown), 2, SCAN_BLOCK))))

    return _bound(_bound(values, cut), inside)


def _spans(kind: str, pieces: Column, ends: Column) -> Column:
    """Confirmed spans: start, end (exclusive), in code points, score. ends: of the pieces."""

    def span(i: Column) -> Column:
        near = F.concat(F.right(F.get(pieces, i - 1), F.lit(CONTEXT_BEFORE)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_AFTER)))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            F.get(ends, i - 1).cast("long").alias("start"), F.get(ends, i).cast("long").alias("end"),
            F.least(F.lit(1.0), score).alias("score"), confirmed(kind, F.get(pieces, i)).alias("ok"),
        )

    found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), span)
    return F.when(F.size(pieces) > 1, F.filter(found, lambda s: s["ok"] & ((s["score"] >= MIN_SCORE) if kind not in BASE else F.lit(True))))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and a column __<kind> for each kind: array of (start, end, score, ok), empty where there is none."""
    out = docs.withColumn("__clean", F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(OTHER)))
    out = out.withColumns({f"__p_{k}": _pieces(k, F.col("__clean")) for k in KINDS})
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,score:double,ok:boolean>>)")
    ends = {f"__e_{k}": F.when(F.size(f"__p_{k}") > 1, scan(F.transform(f"__p_{k}", F.length), F.lit(0), lambda a, n: a + n)) for k in KINDS}
    out = out.withColumns(ends)
    out = out.withColumns({f"__{k}": F.coalesce(_spans(k, F.col(f"__p_{k}"), F.col(f"__e_{k}")), empty) for k in KINDS})
    return out.drop("__clean", *(f"__{x}_{k}" for k in KINDS for x in "pe"))


def _text_of(kinds: tuple[str, ...]) -> Column:
    """kind:start:end, by kind, then start, comma-joined."""
    def written(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", *(written(k) for k in kinds))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in their order)."""
    found = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.concat(*(F.transform(f"__{k}", lambda s: s["score"]) for k in KINDS))
    return found.select("doc_id", *counts, F.sha2(_text_of(BASE), 256).alias("base_sha256"), _text_of(KINDS).alias("spans"), F.transform(scores, lambda x: F.round(x, 2)).alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span, or union of overlapping spans, replaced by its kind in angle brackets; null text stays null.
    n_chars, where there is one, is counted anew."""
    found = with_spans(docs)
    def signed(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("sign")))

    found = found.withColumn("__all", F.array_sort(F.concat(*(signed(k) for k in KINDS))))
    found = found.withColumn("__upto", scan(F.transform("__all", lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b)))
    # The text in chunks of CHUNK code points: a place is found without walking over all that lies before it.
    found = found.withColumn("__chunks", F.when(F.size("__all") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def part(a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        some = F.array_join(F.transform(F.sequence(first, F.floor((b - 1) / CHUNK).cast("int")), lambda i: F.get("__chunks", i)), "")
        return F.when(b > a, F.substring(some, (a - first * CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__upto", i - 1))
        return F.when(s["start"] >= before, F.concat(part(before, s["start"]), s["sign"])).otherwise("")

    cut = F.concat(F.array_join(F.transform("__all", piece), ""), part(F.element_at("__upto", -1), F.length("text").cast("long")))
    out = found.withColumn("text", F.when(F.size("__all") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)
