"""Secret scans, native: regular expressions for known shapes, and character Markov models for random strings of no known shape.

Everything runs as DataFrame functions. Spans come from split() and regexp_extract_all() on the same pattern: what lies between the matches and the matches
themselves alternate, so running sums of their lengths give code-point positions.

Kinds, in order: assign, access, hex (the base), markov. A markov span is a run of 20 or more characters `[A-Za-z0-9+/_=-]` that overlaps no base
span and whose log-likelihood ratio of two first-order Markov models, random strings against ordinary identifiers, is above `least_total` in all and
`least_mean` per character. The models are bigram tables over 66 character classes, counted natively on labelled samples: strings that the base rules
found (random) and the words under 20 characters of a bounded sample of at most about `most_documents` documents without any base match (ordinary), smoothed;
without samples the tables are uniform and nothing is added.

Distribution: one pass over the texts without a shuffle; the samples' bigrams are aggregated to 66 x 66 counts.

Defined results: null text counts as empty; a document without spans has zero counts and the hash of the empty string; null or repeated doc_ids are scanned
row by row; texts of any length are scanned whole; an empty table gives no rows; other columns are ignored, and scan() keeps them, but for one called found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns (fixed values). Runs shorter than asked for are dropped by length, as a whole match or (assign) by its second group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters with a class of their own; all others share class 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"
CLASSES = len(ALPHABET) + 1
#: Weight of the smoothing, in observations.
BACKOFF = 30
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches of pattern as structs (start, kind, end); those whose group is shorter than least are dropped."""
    # arrays are zipped, not looked up inside the lambda, where they would be computed again for each element
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else matches
    parts = F.split(text, pattern, -1)
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), groups.alias("g")), F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, p: F.struct(F.length(p).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["g"]) >= least).alias("kept")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc, s):
        a = acc["at"] + s["gap"]
        one = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + s["size"]).alias("end")))
        return F.struct((a + s["size"]).alias("at"), F.when(s["kept"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    return F.concat(spans(text, ASSIGN, 0, 2, 6), spans(text, ACCESS, 1), spans(text, HEX, 2))


def pairs(string: Column) -> Column:
    """For each two neighbouring characters, class * CLASSES + class."""
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.filter(F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes), F.lit(1))), lambda a, b: a * CLASSES + b), lambda x: x.isNotNull())


def counted(strings: DataFrame) -> dict[int, int]:
    """How often each pair of classes occurs in strings (value): at most CLASSES squared rows."""
    found = strings.select(F.explode(pairs(F.col("value"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["pair"]: r["n"] for r in found}


def ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """Log-likelihood ratio of each pair: transition probabilities of the two models, smoothed towards the second character's own frequency."""

    def model(n: dict[int, int]) -> list[float]:
        total = sum(n.values())
        own = [(sum(n.get(a * CLASSES + b, 0) for a in range(CLASSES)) + 1) / (total + CLASSES) for b in range(CLASSES)]
        rows = [sum(n.get(a * CLASSES + b, 0) for b in range(CLASSES)) for a in range(CLASSES)]
        return [math.log((n.get(a * CLASSES + b, 0) + BACKOFF * own[b]) / (rows[a] + BACKOFF)) for a in range(CLASSES) for b in range(CLASSES)]

    return [x - y for x, y in zip(model(random), model(ordinary))]


def train(docs: DataFrame, most_documents: int = 2_000, most_scanned: int = 20_000) -> list[float]:
    """The table of ratios() from a sample of docs (doc_id, text)."""
    n = max(docs.count(), 1)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("4"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    part = docs.where(F.col("text").isNotNull()).where(draw < min(1.0, most_scanned / n))
    text = F.col("text")
    values = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))))
    random = part.select(F.explode(values).alias("value")).where("length(value) >= 16")
    plain = part.where(draw < min(1.0, most_documents / n)).where(F.size(values) == 0)
    ordinary = plain.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]{4,}"), F.lit(0))).alias("value")).where("length(value) < 20")
    return ratios(counted(random), counted(ordinary))


def scan(docs: DataFrame, table: list[float], least_total: float = 12.0, least_mean: float = 0.6) -> DataFrame:
    """docs with `found`: all spans as an ordered array of (start, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lit = F.lit([float(x) for x in table])
    kept = [c for c in docs.columns if c != "found"]
    rows = docs.select(F.struct(*kept).alias("_row"), text.alias("_text")).withColumn("_base", F.array_sort(base_spans(F.col("_text"))))
    # pos: the candidates; only those outside base spans are scored
    rows = rows.withColumn("_cand", F.filter(spans(F.col("_text"), CANDIDATE, 3), lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))

    def ratio(c):
        string = F.substring(F.col("_text"), c["start"] + 1, c["end"] - c["start"])
        total = F.aggregate(pairs(string), F.lit(0.0), lambda acc, p: acc + F.get(lit, p))
        return F.when(total > F.lit(least_total), total / (c["end"] - c["start"]) > F.lit(least_mean)).otherwise(F.lit(False))

    more = F.when(F.size("_cand") > 0, F.filter("_cand", ratio)).otherwise(F.expr(f"cast(array() as {SPAN})"))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in kept), F.array_sort(F.concat("_base", more)).alias("found"))


def digest(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, most_documents: int = 2_000, most_scanned: int = 20_000) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row of docs."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, train(docs, most_documents, most_scanned))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(digest(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"),
        count(3).alias("n_markov"),
    )


def query(spark, sf_dir):
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spans(name: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""{name} AS (SELECT doc_id, text, {kind} AS kind, v, s, s + length(m) AS e FROM (SELECT doc_id, text, ms[i] AS m, gs[i] AS v,
  (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint AS s
  FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {group}) AS gs, string_split_regex(text, {p}) AS ps FROM d) WHERE len(ms) > 0))
  WHERE length(v) >= {least})"""


def _sql_counts(name: str, source: str) -> str:
    """Pairs of classes of the strings (column v) of source, and the smoothed model of them."""
    cls = lambda k: f"instr('{ALPHABET}', substr(v, {k}, 1))"
    return f"""{name}_n AS (SELECT a, b, count(*)::double AS n FROM (SELECT {cls("i")} AS a, {cls("i + 1")} AS b FROM (SELECT v, unnest(generate_series(1, length(v) - 1)) AS i FROM {source})) GROUP BY a, b),
{name} AS (SELECT g.a, g.b, ln((coalesce(n.n, 0) + {BACKOFF} * (coalesce(o.n, 0) + 1) / ((SELECT coalesce(sum(n), 0) FROM {name}_n) + {CLASSES})) / (coalesce(r.n, 0) + {BACKOFF})) AS p
  FROM (SELECT a, unnest(generate_series(0, {CLASSES - 1})) AS b FROM (SELECT unnest(generate_series(0, {CLASSES - 1})) AS a)) g LEFT JOIN {name}_n n ON n.a = g.a AND n.b = g.b
  LEFT JOIN (SELECT b, sum(n) AS n FROM {name}_n GROUP BY b) o ON o.b = g.b LEFT JOIN (SELECT a, sum(n) AS n FROM {name}_n GROUP BY a) r ON r.a = g.a)"""


_NAME = "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END || ':' || s || ':' || e"
_SOME = f"regexp_matches(text, '{ASSIGN.replace(chr(39), chr(39) * 2)}') OR regexp_matches(text, '{ACCESS}') OR regexp_matches(text, '{HEX}')"
#: The same in DuckDB, model included.
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS missing, ('0x' || substr(md5('4:' || coalesce(doc_id::varchar, '')), 1, 8))::ubigint::double / 4294967296.0 AS u, (SELECT greatest(count(*), 1) FROM documents) AS total FROM documents),\n"
    + ",\n".join((_sql_spans("a0", ASSIGN, 0, 2), _sql_spans("k1", ACCESS, 1), _sql_spans("k2", HEX, 2), _sql_spans("c3", CANDIDATE, 3)))
    + ",\nk0 AS (SELECT * FROM a0 WHERE length(v) >= 6), base AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),\n"
    + "rnd AS (SELECT v FROM (SELECT * FROM a0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) JOIN d USING (doc_id) WHERE length(v) >= 16 AND u < least(1.0, 20000.0 / total)),\n"
    + f"ord AS (SELECT v FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]{{4,}}')) AS v FROM d WHERE NOT missing AND u < least(1.0, 20000.0 / total) AND u < least(1.0, 2000.0 / total) AND NOT ({_SOME})) WHERE length(v) < 20),\n"
    + _sql_counts("mr", "rnd") + ",\n" + _sql_counts("mo", "ord")
    + ",\ncand AS (SELECT * FROM c3 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c3.doc_id AND b.s < c3.e AND c3.s < b.e)),\n"
    + f"llr AS (SELECT doc_id, kind, s, e, sum(mr.p - mo.p) AS total FROM (SELECT *, instr('{ALPHABET}', substr(v, i, 1)) AS a, instr('{ALPHABET}', substr(v, i + 1, 1)) AS b FROM (SELECT *, unnest(generate_series(1, length(v) - 1)) AS i FROM cand)) JOIN mr USING (a, b) JOIN mo USING (a, b) GROUP BY doc_id, kind, s, e),\n"
    + "more AS (SELECT * FROM llr WHERE total > 12 AND total / (e - s) > 0.6),\n"
    + f"list AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, string_agg({_NAME}, ',' ORDER BY s, kind) FILTER (kind < 3) AS b, string_agg({_NAME}, ',' ORDER BY s, kind) AS x FROM (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, kind, s, e FROM more) GROUP BY doc_id)\n"
    + "SELECT doc_id, coalesce(n0, 0)::bigint AS n_assign, coalesce(n1, 0)::bigint AS n_access, coalesce(n2, 0)::bigint AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans, coalesce(n3, 0)::bigint AS n_markov FROM d LEFT JOIN list USING (doc_id)"
)
