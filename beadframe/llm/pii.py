"""Personal data by patterns, checksums and context, in DataFrame functions only.

A pattern proposes spans; a check confirms them (Luhn for cards, mod-97 for bank account
numbers, value ranges for addresses, digit counts for phones, entropy for keys and
tokens); words nearby raise the score. Base kinds are kept whatever their score, added kinds from ``accept`` on.

The base patterns are written so that matching takes linear time in any text: where the
contract's pattern may start anywhere in a run of characters, the one here starts at the
run's first character (or where the last match ended), and takes runs without giving
characters back. The matches are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Confirms a match ``m``.
    check: str
    score: float
    #: Words whose presence within NEAR characters adds ``BONUS``.
    context: str
    base: bool = True
    #: Text that must be there for a match; spares the pattern elsewhere.
    hint: str | None = None


DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"
MOD97 = (
    "aggregate(split(concat(substring(regexp_replace(m, ' ', ''), 5), substring(m, 1, 4)), ''), 0L, "
    "(a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
)
#: Bits a character of a match: random keys have more than words and numbers.
ENTROPY = "aggregate(transform(array_distinct(split(m, '')), c -> (length(m) - length(replace(m, c, ''))) / length(m)), 0D, (a, p) -> IF(p > 0, a - p * log2(p), a))"
# Forms of access keys.
KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}"
# The four base kinds and their order are given, as are their limits.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.8, "mail|contact|write to", hint="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"forall(split(m, '\\.'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', right(p, 3)) AS INT) <= 255)", 0.6, "ip|host|server|address|login", hint="."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", "luhn_check(regexp_replace(m, '[^0-9]', ''))", 0.7, "card|visa|credit|payment|debit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{DIGITS} BETWEEN 10 AND 15", 0.6, "phone|tel|call|fax|mobile", hint="+"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", MOD97, 0.9, "iban|account|bank|transfer", base=False),
    Kind("key", KEYS, f"{ENTROPY} >= 3.0", 0.8, "key|token|secret", base=False),
    Kind("token", r"[A-Za-z0-9+/_-]{20,}+", f"length(m) <= 128 AND {DIGITS} BETWEEN 2 AND length(m) - 2 AND {ENTROPY} >= 3.0", 0.4, "token|secret|passw|key|auth|bearer|credential", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "substring(m, 1, 3) NOT IN ('000', '666') AND substring(m, 1, 1) <> '9'", 0.4, "ssn|social|security|tax|insured", base=False, hint="-"),
]
NEAR, BONUS, ACCEPT, BLOCK = 40, 0.3, 0.6, 256


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def span_array(kind: Kind, order: int) -> Column:
    """array<struct<start, place, kind, end, value, score>> from the columns ``text`` and ``found_<kind>``."""
    n, found = kind.name, f"found_{kind.name}"
    # Starts are running sums. An array grown element by element is copied each time, so it is
    # grown in blocks, from the blocks' own running sum: time stays nearly linear in the matches.
    span = "struct<start: bigint, end: bigint, m: string>"
    blocks = f"transform(sequence(1, size(z), {BLOCK}), b -> slice(z, b, {BLOCK}))"
    placed = f"""element_at(transform(array(zip_with({found}, slice(split(text, {literal(kind.pattern)}, -1), 1, size({found})), (m, gap) -> struct(length(gap) AS g, m))), z ->
      flatten(zip_with({blocks},
        aggregate(transform({blocks}, b -> aggregate(b, 0L, (s, x) -> s + x.g + length(x.m))),
          struct(0L AS at, CAST(array() AS array<bigint>) AS out), (a, s) -> struct(a.at + s AS at, concat(a.out, array(a.at)) AS out), a -> a.out),
        (block, first) -> aggregate(block, struct(first AS at, CAST(array() AS array<{span}>) AS out),
          (a, x) -> struct(a.at + x.g + length(x.m) AS at, concat(a.out, array(struct(a.at + x.g AS start, a.at + x.g + length(x.m) AS end, x.m AS m))) AS out),
          a -> a.out)))), 1)"""
    around = f"lower(substring(text, CAST(greatest(0, x.start - {NEAR}) AS INT) + 1, CAST(x.end - x.start + 2 * {NEAR} AS INT)))"
    score = f"least(1.0D, {kind.score}D + IF({around} RLIKE {literal(kind.context)}, {BONUS}D, 0.0D))"
    checked = f"filter({placed}, y -> exists(array(y.m), m -> {kind.check}))"
    spans = f"transform({checked}, x -> struct(x.start, {order} AS place, {literal(n)} AS kind, x.end, x.m AS value, {score} AS score))"
    return F.expr(f"CASE WHEN size({found}) > 0 THEN {spans} ELSE CAST(array() AS array<struct<start: bigint, place: int, kind: string, end: bigint, value: string, score: double>>) END")


def find(docs: DataFrame, text: str = "text", id: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """(id, spans): a row a document; spans sorted by start, then kind.

    A span is a struct (start, place, kind, end, value, score); start and end are code
    points, end exclusive. Null and empty texts have none; texts of any length are
    searched whole. Two kinds that start at one place are sorted as KINDS lists them.
    Repeated rows and null ids are kept as they are, other columns are not read, whatever
    their names, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    none = F.expr("CAST(array() AS array<string>)")
    for k in KINDS:
        found = F.expr(f"regexp_extract_all(text, {literal(k.pattern)}, 0)")
        rows = rows.withColumn(f"found_{k.name}", F.when(F.contains("text", F.lit(k.hint)), found).otherwise(none) if k.hint else found)
    arrays = [span_array(k, i) for i, k in enumerate(KINDS)]
    kept = [a if k.base else F.filter(a, lambda x: x["score"] >= accept) for k, a in zip(KINDS, arrays)]
    return rows.select(id, F.array_sort(F.concat(*kept)).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Adds base counts, the base spans' SHA-256 and all spans as one string."""
    base = [k.name for k in KINDS if k.base]
    said = "transform({}, x -> concat(x.kind, ':', x.start, ':', x.end))"
    names = ", ".join(literal(b) for b in base)
    counts = {f"n_{b}": F.expr(f"CAST(size(filter(spans, x -> x.kind = {literal(b)})) AS BIGINT)") for b in base}
    text = F.array_join(F.expr(said.format(f"filter(spans, x -> x.kind IN ({names}))")), ",")
    counts["n_added"] = F.expr(f"CAST(size(filter(spans, x -> x.kind NOT IN ({names}))) AS BIGINT)")
    counts["n_all"] = F.size("spans").cast("long")
    return found.withColumns(counts | {"base_sha256": F.sha2(text, 256)}).withColumn("spans", F.array_join(F.expr(said.format("spans")), ","))


def oracle_sql() -> str:
    """The query over ``documents`` as DuckDB SQL, from the contract's own patterns."""
    mod97 = "list_reduce(list_prepend(0::BIGINT, [CASE WHEN c <= '9' THEN ord(c) - 48 ELSE ord(c) - 55 END::BIGINT for c in string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), '')]), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN d ELSE (d * 2) // 10 + (d * 2) % 10 END for d, i in [x::INT for x in string_split(reverse({digits}), '')]]) % 10 = 0"
    entropy = "list_entropy(string_split(m, ''))"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len([p for p in string_split(m, '.') if p::HUGEINT > 255]) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", mod97),
        ("key", KEYS, f"{entropy} >= 3.0"),
        ("token", "[A-Za-z0-9+/_-]{20,}", f"length(m) <= 128 AND length({digits}) BETWEEN 2 AND length(m) - 2 AND {entropy} >= 3.0 AND near"),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND near"),
    ]
    parts = []
    for i, (name, pattern, check) in enumerate(kinds):
        near = f"regexp_matches(lower(substr(text, greatest(0, s - {NEAR}) + 1, e - s + 2 * {NEAR})), '{KINDS[i].context}')"
        parts.append(f"""SELECT doc_id, text, '{name}' AS kind, {i} AS place, m, s, e FROM (
  SELECT *, s + length(m) AS e, {near.replace("e - s", "length(m)")} AS near FROM (
    SELECT doc_id, text, found[i] AS m, i,
      (list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in found[1:i-1]]), 0))::BIGINT AS s
    FROM (SELECT doc_id, text, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM documents)))
  ) WHERE {check}""")
    union = "\nUNION ALL ".join(f"({p})" for p in parts)
    base = [k.name for k in KINDS if k.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{b}')::BIGINT AS n_{b}" for b in base)
    counts += ", count(*) FILTER (place >= 4)::BIGINT AS n_added, count(place)::BIGINT AS n_all"
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place){}, '')"
    return f"""
WITH f AS ({union})
SELECT d.doc_id, {counts}, sha256({joined.format(" FILTER (place < 4)")}) AS base_sha256, {joined.format("")} AS spans
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
