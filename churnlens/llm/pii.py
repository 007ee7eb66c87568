"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

All steps are SQL functions. Positions come from splitting the text at the matches: a match
starts after the pieces and matches before it, so starts are running sums of lengths (in code
points), taken in blocks so that a text with very many matches costs little more than its length.
Patterns are written so that every start that cannot match is left at once (possessive runs,
no start inside a run), which keeps them linear on very long runs; they match exactly what the
plain patterns in the comments match.

Kinds email, ip, card and phone are reported whenever their own rule holds. The kinds after them
are proposed by a pattern and kept if their checksum holds and their score reaches ``min_score``.

Defined cases: a null or empty text has no spans (empty strings, digest of the empty string);
ties at one start are ordered by kind, then end; repeated rows are scanned each; other columns
are kept, equal-named ones replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.registry import query, table

#: Lengths summed in one block.
BLOCK = 512
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 40
MIN_SCORE = 0.7


class Kind(NamedTuple):
    name: str
    gate: str       # SQL over the text column t: false if nothing can match
    pattern: str
    valid: str      # SQL over the match m
    score: float    # of a valid match
    context: str    # pattern over the lower-case characters around it
    bonus: float    # added when the context matches


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = _digits(m)
    each = f"CAST(substring({d}, -i, 1) AS INT)"
    return (f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + "
            f"IF(i % 2 = 1, {each}, 2 * {each} - IF({each} > 4, 9, 0))) % 10 = 0")


def _mod97(m: str) -> str:
    s = f"replace({m}, ' ', '')"
    turned = f"concat(substring({s}, 5), left({s}, 4))"
    return (f"aggregate(split({turned}, ''), 0, (a, c) -> IF(c = '', a, IF(c <= '9', a * 10 + CAST(c AS INT), "
            f"a * 100 + ascii(c) - 55) % 97)) = 1")


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", "contains(t, '@')", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "true",
         0.9, "mail|contact|courriel|correo", 0.1),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"t RLIKE '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"forall(split(m, '[.]'), p -> p RLIKE '^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
         0.7, "address|adresse|direcci|server|host|login", 0.2),
    # [0-9]([\x20-]?[0-9])+, 14 to 19 digits, Luhn
    Kind("card", r"t RLIKE '[0-9](?:[ -]?[0-9]){13}'", r"[0-9](?:[ -]?[0-9])++",
         f"length({_digits('m')}) BETWEEN 14 AND 19 AND {_luhn('m')}", 0.8, "card|credit|visa|carte|karte|tarjeta", 0.2),
    # \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
    Kind("phone", "contains(t, '+')", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_digits('m')}) BETWEEN 10 AND 15",
         0.8, "call|phone|tel|mobile", 0.2),
    Kind("iban", r"t RLIKE '[A-Z]{2}[0-9]{2} ?[A-Z0-9]'",
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _mod97("m"),
         0.8, "iban|account|konto|compte|cuenta|bank", 0.2),
    Kind("ssn", "t RLIKE '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
         r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         "NOT (m RLIKE '^(?:000|666|9)' OR m LIKE '%-00-%' OR m LIKE '%-0000')",
         0.4, "ssn|social security", 0.4),
)
BASE = tuple(k.name for k in KINDS[:4])


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def find_pii(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Add ``pii``: array of (start, kind_no, end, kind, score), ordered by start, kind, end."""
    keep = [c for c in df.columns if c != "pii"]
    # The operator's own columns stand beside the input packed in one struct: no name can clash.
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    empty = "CAST(array() AS ARRAY<BIGINT>)"

    def add(of) -> None:
        nonlocal out
        out = out.selectExpr("*", *[f"{of(k)} AS {of.__name__}_{k.name}" for k in KINDS])

    def found(k: Kind) -> str:
        return f"CASE WHEN {k.gate} THEN regexp_extract_all(t, {_sql(k.pattern)}, 0) ELSE array() END"

    def pieces(k: Kind) -> str:
        return f"CASE WHEN size(found_{k.name}) > 0 THEN transform(split(t, {_sql(k.pattern)}, -1), x -> length(x)) END"

    def gaps(k: Kind) -> str:   # from the last match's start to this one's
        return (f"CASE WHEN size(found_{k.name}) > 0 THEN transform(found_{k.name}, (m, i) -> CAST(pieces_{k.name}[i] "
                f"+ IF(i > 0, length(found_{k.name}[i - 1]), 0) AS BIGINT)) ELSE {empty} END")

    def blocks(k: Kind) -> str:
        g = f"gaps_{k.name}"
        return (f"CASE WHEN size({g}) > 0 THEN aggregate(sequence(0, (size({g}) - 1) div {BLOCK}), array(0L), (a, b) -> "
                f"concat(a, array(element_at(a, -1) + aggregate(slice({g}, CAST(b * {BLOCK} + 1 AS INT), {BLOCK}), 0L, "
                f"(x, y) -> x + y)))) END")

    def starts(k: Kind) -> str:
        g = f"gaps_{k.name}"
        return (f"CASE WHEN size({g}) > 0 THEN flatten(transform(sequence(0, (size({g}) - 1) div {BLOCK}), b -> slice("
                f"aggregate(slice({g}, CAST(b * {BLOCK} + 1 AS INT), {BLOCK}), array(blocks_{k.name}[b]), (a, y) -> "
                f"concat(a, array(element_at(a, -1) + y))), 2, {BLOCK}))) ELSE {empty} END")

    def spans(k: Kind) -> str:
        no = KINDS.index(k)
        at = f"starts_{k.name}[i]"
        around = (f"lower(concat(substring(t, CAST(greatest({at} - {CONTEXT_CHARS}, 0) + 1 AS INT), "
                  f"CAST(least({at}, {CONTEXT_CHARS}) AS INT)), ' ', "
                  f"substring(t, CAST({at} + length(m) + 1 AS INT), {CONTEXT_CHARS})))")
        score = f"CAST(least(1.0D, {k.score}D + IF({around} RLIKE '{k.context}', {k.bonus}D, 0.0D)) AS DOUBLE)"
        least = -1.0 if k.name in BASE else min_score
        return (f"filter(transform(found_{k.name}, (m, i) -> IF({k.valid}, struct({at} AS start, {no} AS kind_no, "
                f"{at} + length(m) AS end, '{k.name}' AS kind, {score} AS score), NULL)), "
                f"s -> s IS NOT NULL AND s.score >= {least}D)")

    for step in (found, pieces, gaps, blocks, starts, spans):
        add(step)
    every = ", ".join(f"spans_{k.name}" for k in KINDS)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.expr(f"array_sort(concat({every}))").alias("pii"))


def span_list(pii: str, where: str = "true") -> str:
    """SQL of the spans as kind:start:end, comma-joined."""
    return (f"array_join(transform(filter({pii}, s -> {where}), "
            f"s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts by kind, digest of the base spans, all spans with scores."""
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = f"s.kind_no < {len(BASE)}"
    return docs.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({span_list('pii', base)}, 256)").alias("base_sha256"),
        F.expr(span_list("pii")).alias("spans"),
        F.expr("transform(pii, s -> s.score)").alias("scores"))
