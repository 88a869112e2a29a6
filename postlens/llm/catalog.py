"""Registered queries of the training-data operators, with oracle SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlens.llm import (
    bpe, line_dedup, merkle, near_dedup, neighbours, packing, quality, quality_model, runs, secrets, substring_dedup,
    token_counts, toxicity,
)
from postlens.plans.registry import Registry, table
from postlens.session import scratch_path

R = Registry()

END_OF_TEXT = 50256
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")

OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), classes AS (
    SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), shingles AS (
    SELECT rep, len(s) AS n, unnest(s) AS shingle FROM classes
), links AS (
    SELECT a.rep AS u, b.rep AS v FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT rep AS u, rep AS v FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
    SELECT u, min(v) AS component FROM reach GROUP BY u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id,
    s.doc_id = coalesce(l.component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN least l ON l.u = c.rep
"""


@R.add("op1_near_dedup", OP1_SQL)
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), near_dedup.Similarity(percent=85))


@R.add("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), BPE_FILE, 1024, 2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


OP3_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
    SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT doc_id, pos, line, r.k IS NOT NULL AND doc_id <> r.keeper AS dropped
    FROM keyed LEFT JOIN repeated r ON keyed.k = r.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@R.add("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@R.add("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, folder, "documents"))


@R.add("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, BPE_FILE).drop("text"), BPE_FILE)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@R.add("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"), RANK_FILE)
    spans, base = F.col("secrets"), F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(spans).alias("spans"), count("random").alias("n_random"))


@R.add("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "zstd_ratio", "n_chunks", "n_bad_chunks")


@R.add("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as flat token files, then one row per document found in them, with its id."""
    files, docs = scratch_path(spark, "flat"), table(spark, folder, "documents")
    token_counts.write_flat(docs, BPE_FILE, files, END_OF_TEXT)
    found = token_counts.count_tokens(spark, files, END_OF_TEXT, joined=True)
    shard = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    counted = found.select(shard.alias("shard"), "doc_no", "start", "n_tokens", "ended")
    return token_counts.written_places(docs).join(counted, ["shard", "doc_no"]).select(
        "doc_id", "shard", "doc_no", "start", "n_tokens", "ended")


@R.add("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model.train(docs, quality_model.grades_of(table(spark, folder, "labels")))
    return quality_model.score(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")


OP10_SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, min(sqrt(list_reduce(
        list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b))) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""


@R.add("op10_vantage_point_search", OP10_SQL)
def op10_vantage_point_search(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, factor=1.0)


def id_hash(name: str = "doc_id") -> Column:
    """Unsigned crc32 of an id's decimal digits."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


@R.add("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Models of the labels that are not held out, over every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.pmod(id_hash(), F.lit(3)) == 1
    model = toxicity.train(docs.where(~held), table(spark, folder, "labels").where(~held))
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "comparison")


# crc32 of the decimal id: table by the published polynomial, then one step per digit
CRC_SQL = """
crc_steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hashed AS (
    SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i::INTEGER, 1)) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM documents d, crc_steps
)"""
OCTAVES = 18


def _octaves_sql() -> str:
    """Windows of doubled length and, per octave of lags, the stretches that come again at one distance."""
    parts = ["w0 AS (SELECT doc_id, g, i, hash(w) AS k FROM s3)"]
    for n in range(OCTAVES):
        step = 1 << n
        parts.append(
            f"w{n + 1} AS (SELECT doc_id, g, i, hash(k, lead(k, {step}) OVER o) AS k FROM w{n} "
            f"WINDOW o AS (PARTITION BY doc_id, g ORDER BY i) QUALIFY lead(k, {step}) OVER o IS NOT NULL)")
        parts.append(
            f"d{n + 1} AS (SELECT doc_id, g, i, lead(i) OVER (PARTITION BY doc_id, g, k ORDER BY i) - i AS q FROM w{n + 1})")
    parts.append("near AS (" + " UNION ALL ".join(
        f"SELECT doc_id, g, i, q FROM d{n + 1} WHERE q >= {1 << n} AND q < {2 << n}" for n in range(OCTAVES)) + ")")
    return ",\n".join(parts)


OP12_SQL = rf"""
WITH {CRC_SQL}, split AS (
    SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM hashed
), base AS (
    SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS planted, g % len(o) AS a,
        1 + (len(o) - g % len(o)) // (3 + g % 8) AS p FROM split
), texts AS (
    SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM base
), words AS (
    SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM texts
), s1 AS (
    SELECT doc_id, i, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
        (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM words) WHERE c >= 4
), s2 AS (
    SELECT doc_id, i, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
        (SELECT *, count(*) OVER (PARTITION BY doc_id, g, w) AS c, count(*) OVER (PARTITION BY doc_id, g) AS m FROM s1) WHERE c >= 4 AND m >= 6
), s3 AS (
    SELECT doc_id, g, i, w FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS m FROM s2) WHERE m >= 6
), {_octaves_sql()}, parts AS (
    SELECT doc_id, q, min(i) AS i FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, g, q ORDER BY i) AS e FROM near)
    GROUP BY doc_id, g, q, e HAVING count(*) > q
), same AS (
    SELECT c.doc_id, c.q, x.i, x.i - row_number() OVER (PARTITION BY c.doc_id, c.q ORDER BY x.i) AS e
    FROM (SELECT DISTINCT doc_id, q FROM parts) c JOIN words x ON x.doc_id = c.doc_id
    JOIN words y ON y.doc_id = x.doc_id AND y.i = x.i + c.q AND y.w = x.w
), stretches AS (
    SELECT doc_id, q, min(i) AS lo, max(i) AS hi FROM same GROUP BY doc_id, q, e
), found AS (
    SELECT DISTINCT s.doc_id, s.lo AS start, s.hi - s.lo + 1 + s.q AS length, s.q AS period
    FROM stretches s JOIN parts p ON p.doc_id = s.doc_id AND p.q = s.q AND p.i BETWEEN s.lo AND s.hi
    WHERE s.hi - s.lo + 1 + s.q >= greatest(6, 4 * s.q)
), best AS (
    SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l
    FROM found GROUP BY doc_id
), dropped AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found
), kept AS (
    SELECT x.doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words x ANTI JOIN dropped d ON d.doc_id = x.doc_id AND d.i = x.i GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
    (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the hash of its id, repeats a stretch of itself up to its end."""
    # no lambda: Spark does not take one in the argument of a Python function
    h = id_hash()
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), copies)), F.lit(1), n - a)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.withColumn("text", F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), repeated).otherwise(F.col("text")))


@R.add("op12_periodic_runs", OP12_SQL)
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(planted(table(spark, folder, "documents").select("doc_id", "text")))
    best = runs.longest(F.col("runs"))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _merkle_sql(leaf_levels: int = 5, root_levels: int = 3) -> str:
    """Level by level, every run of sixteen as a list; a leaf's siblings are its run without itself."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"
    parts = [CRC_SQL, f"""leaves AS (
    SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN h % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS shown,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM hashed
), n0 AS (SELECT source, i, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM leaves)"""]

    def levels(prefix: str, count: int, key: str) -> None:
        for k in range(count):
            parts.append(f"{prefix}r{k} AS (SELECT {key}, i // 16 AS i, list(d ORDER BY i) AS ds, any_value(n) AS n FROM {prefix}n{k} GROUP BY {key}, i // 16)")
            parts.append(f"{prefix}n{k + 1} AS (SELECT {key}, i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, "
                         f"count(*) OVER (PARTITION BY {key}) AS n FROM {prefix}r{k})")

    levels("", leaf_levels, "source")
    parts.append(f"subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS si FROM n{leaf_levels})")
    parts.append("tn0 AS (SELECT 0 AS one, si AS i, subroot AS d, count(*) OVER () AS n FROM subroots)")
    levels("t", root_levels, "one")
    parts.append("f0 AS (SELECT l.doc_id, l.source, l.leaf, l.i, shown AS d, '' AS proof, s.subroot, s.si FROM leaves l "
                 "JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source)")

    def folds(first: int, prefix: str, count: int, place: str, match: str) -> None:
        for k in range(count):
            run, at = f"{place} // (16 ** {k + 1})::BIGINT", f"({place} // (16 ** {k})::BIGINT % 16)::INTEGER"
            others = f"array_to_string(list_concat(r.ds[1:{at}], r.ds[{at} + 2:]), '')"
            whole = f"array_to_string(list_concat(list_concat(r.ds[1:{at}], [f.d]), r.ds[{at} + 2:]), '')"
            parts.append(f"f{first + k + 1} AS (SELECT f.* REPLACE (CASE WHEN r.n > 1 THEN sha256({whole}) ELSE f.d END AS d, "
                         f"CASE WHEN r.n > 1 THEN f.proof || {others} ELSE f.proof END AS proof) "
                         f"FROM f{first + k} f JOIN {prefix}r{k} r ON {match} AND r.i = {run})")

    folds(0, "", leaf_levels, "f.i", "r.source IS NOT DISTINCT FROM f.source")
    folds(leaf_levels, "t", root_levels, "f.si", "r.one = 0")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, (SELECT any_value(d) FROM tn{root_levels}) AS root, sha256(proof) AS proof_sha256, d AS folded_root,
    d = (SELECT any_value(d) FROM tn{root_levels}) AS verified FROM f{leaf_levels + root_levels}"""


@R.add("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest by source; every fifth document, by the hash of its id, is shown with its letters lowered."""
    docs = table(spark, folder, "documents")
    lowered = line_dedup.ascii_lower(F.col("text"))
    fields = [F.col(f) for f in FIELDS]
    shown = F.when(F.pmod(id_hash(), F.lit(5)) == 0, merkle.leaf_digest([*fields[:-1], lowered])).otherwise(merkle.leaf_digest(fields))
    made = merkle.manifest(docs, fields, F.col("source"), F.col("doc_id"), presented=shown, keep=["doc_id"])
    return merkle.proofs(made)


def queries() -> dict:
    return dict(R.queries)


def oracles() -> dict:
    return dict(R.oracles)
