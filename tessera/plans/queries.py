"""One query an operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import jvm
from tessera.operators import bytes_ops, cases, chunks, images, jobs, matching, report, rifts
from tessera.session import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the text's bytes as `content`; null texts are empty."""
    return _table(spark, sf_dir, "documents").select("doc_id", bytes_ops.utf8(F.coalesce("text", F.lit(""))).alias("content"))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_texts(), dealt out for the codecs."""
    bounded_batches(spark)
    return jobs.spread(_texts(spark, sf_dir))


_DOCS = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
_IDENTITY = f"SELECT doc_id, md5(t) AS digest, CAST(strlen(t) AS BIGINT) AS n_bytes FROM ({_DOCS})"


def _digest(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("doc_id", F.md5(column).alias("digest"), F.octet_length(column).cast("bigint").alias("n_bytes"))


# --- Signatures and framing ---------------------------------------------------------------------------------


def _signature(algorithm: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select("doc_id", bytes_ops.signature(F.col("content"), algorithm).alias("signature"))

    return run


for _name, _number in (("md5", bytes_ops.MD5), ("sha1", bytes_ops.SHA1), ("sha256", bytes_ops.SHA256)):
    query(f"q_signature_{_name}", f"SELECT doc_id, {_name}(t) AS signature FROM ({_DOCS})")(_signature(_number))


@query("q_crc32")
def q_crc32(spark, sf_dir):
    content = F.col("content")
    return _texts(spark, sf_dir).select("doc_id", bytes_ops.crc(content).alias("crc"), bytes_ops.crc_register(content).alias("crc_register"))


@query("q_dcm_wrap", f"SELECT doc_id, sha256('DCM' || chr(1) || t) AS wrapped, md5(t) AS stripped, TRUE AS is_dcm, FALSE AS was_dcm FROM ({_DOCS})")
def q_dcm_wrap(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("wrapped", bytes_ops.dcm_wrap(F.col("content")))
    wrapped = F.col("wrapped")
    return rows.select(
        "doc_id", F.sha2(wrapped, 256).alias("wrapped"), F.md5(bytes_ops.dcm_strip(wrapped)).alias("stripped"),
        bytes_ops.is_dcm(wrapped).alias("is_dcm"), bytes_ops.is_dcm(F.col("content")).alias("was_dcm"),
    )


# --- Deltas -------------------------------------------------------------------------------------------------


def _round_trip(version: str, options: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = jobs.with_neighbour(_table(spark, sf_dir, "documents"), "doc_id", "text")
        return _digest(jobs.apply(jobs.create(pairs, version, options)), "result")

    return run


for _name, _version, _options in (
    ("raw", "PA30", ""), ("pa31", "PA31", "sha256"), ("hash_md5", "PA30", "md5"), ("hash_sha256", "PA30", "sha256"), ("bsdiff_flag", "PA30", "bsdiff"),
):
    query(f"q_roundtrip_{_name}", _IDENTITY)(_round_trip(_version, _options))


@query("q_reverse", "SELECT d.doc_id, md5(coalesce(r.text, '')) AS digest, CAST(strlen(coalesce(r.text, '')) AS BIGINT) AS n_bytes FROM documents d LEFT JOIN documents r ON r.doc_id = d.doc_id - 1")
def q_reverse(spark, sf_dir):
    """Back from each document to the one before it, by the reverse of the delta between them."""
    pairs = jobs.create(jobs.with_neighbour(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    both = jobs.apply_reverse(pairs).select("doc_id", F.col("result").alias("reference"), F.col("reverse").alias("delta"))
    return _digest(jobs.apply(both), "result")


@query(
    "q_delta_info",
    f"SELECT doc_id, 'PA31' AS version, CAST(1 AS BIGINT) AS file_type_set, CAST(1 AS BIGINT) AS file_type, CAST(131072 AS BIGINT) AS flags, "
    f"CAST(strlen(t) AS BIGINT) AS target_size, 32771 AS hash_algorithm, md5(t) AS target_hash FROM ({_DOCS})",
)
def q_delta_info(spark, sf_dir):
    pairs = jobs.create(jobs.with_neighbour(_table(spark, sf_dir, "documents"), "doc_id", "text"), "PA31", "md5")
    found = jobs.info(pairs.select("doc_id", "delta"))
    return found.select("doc_id", "version", "file_type_set", "file_type", "flags", "target_size", "hash_algorithm", F.lower(F.hex("target_hash")).alias("target_hash"))


# --- Codecs and containers ----------------------------------------------------------------------------------


@query("q_lzms_roundtrip", _IDENTITY)
def q_lzms_roundtrip(spark, sf_dir):
    packed = jvm.encoded(_work(spark, sf_dir), "packed", "lzms_compress", "content")
    return _digest(jvm.decoded(packed, "plain", "lzms_decompress", "packed", F.octet_length("content")), "plain")


@query("q_container_roundtrip", _IDENTITY)
def q_container_roundtrip(spark, sf_dir):
    packed = jvm.encoded(_work(spark, sf_dir), "packed", "container_write", "content", F.lit(1 << 16))
    return _digest(jvm.decoded(packed, "plain", "container_read", "packed"), "plain")


@query("q_wim_roundtrip", _IDENTITY)
def q_wim_roundtrip(spark, sf_dir):
    packed = jvm.encoded(_work(spark, sf_dir), "packed", "wim_write", "content", F.lit(1 << 12))
    return _digest(jvm.decoded(packed, "plain", "wim_read", "packed", F.lit(1 << 12), F.octet_length("content")), "plain")


@query("q_wim_solid_chunks", _IDENTITY)
def q_wim_solid_chunks(spark, sf_dir):
    """Solid resources, unpacked chunk by chunk in parallel, and put together again."""
    texts = _work(spark, sf_dir)
    resources = jvm.encoded(texts, "resource", "wim_solid_write", "content", F.lit(1 << 12)).select("doc_id", "resource")
    rows = chunks.solid_chunks(resources, "doc_id", "resource")
    rows = jvm.decoded(rows, "content", "lzms_expand", "data", "plain")
    plain = chunks.reassembled(rows.select(F.col("key").alias("doc_id"), "chunk", "content"), "doc_id", "content")
    return _digest(texts.select("doc_id").join(plain, "doc_id", "left").withColumn("content", F.coalesce("content", F.lit(b""))), "content")


@query(
    "q_wim_range",
    f"SELECT doc_id, sha256(unhex(substr(hex(encode(t)), 2 * CAST(strlen(t) // 3 AS BIGINT) + 1, 2 * CAST((strlen(t) + 2) // 3 AS BIGINT)))) AS digest FROM ({_DOCS}) WHERE strlen(t) > 0",
)
def q_wim_range(spark, sf_dir):
    """The middle third of each document out of its solid resource; only the chunks that it lies in are unpacked."""
    n = F.octet_length("content")
    rows = jvm.encoded(_work(spark, sf_dir).filter(n > 0), "resource", "wim_solid_write", "content", F.lit(1 << 10))
    rows = jvm.decoded(rows, "part", "wim_solid_range", "resource", F.floor(n / 3).cast("int"), F.floor((n + 2) / 3).cast("int"))
    return rows.select("doc_id", F.sha2("part", 256).alias("digest"))


@query("q_bsdiff_roundtrip", _IDENTITY)
def q_bsdiff_roundtrip(spark, sf_dir):
    bounded_batches(spark)
    pairs = jvm.encoded(jobs.with_neighbour(_table(spark, sf_dir, "documents"), "doc_id", "text"), "patch", "bsdiff_create", "reference", "target")
    return _digest(jvm.decoded(pairs, "result", "bsdiff_patch", "reference", F.octet_length("target"), "patch"), "result")


@query(
    "q_chunk_index",
    f"""WITH d AS (SELECT doc_id, strlen(t) AS n FROM ({_DOCS}) WHERE strlen(t) > 0),
c AS (SELECT doc_id, unnest(range(0, CAST((n + 1023) // 1024 AS BIGINT))) AS chunk, n FROM d),
l AS (SELECT doc_id, chunk, least(1024, n - 1024 * chunk) AS plain FROM c)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(plain AS BIGINT) AS plain,
  CAST(16 + coalesce(sum(plain) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS on_disk FROM l""",
)
def q_chunk_index(spark, sf_dir):
    rows = chunks.chunked(_texts(spark, sf_dir), "doc_id", "content", 1024)
    lengths = rows.select("doc_id", "chunk", F.octet_length("plain").cast("bigint").alias("plain"))
    return chunks.chunk_index(lengths, "doc_id", "chunk", "plain", 16)


# --- Piecewise maps -----------------------------------------------------------------------------------------

_MAP_A = "SELECT user_id, event_id AS source, event_id + CAST(floor(value) AS BIGINT) AS target FROM events WHERE event_type = 'purchase'"
_MAP_B = "SELECT user_id, event_id AS source, event_id - CAST(floor(value) AS BIGINT) AS target FROM events WHERE event_type = 'signup'"


def _map(spark: SparkSession, sf_dir: str, kind: str, sign: int) -> DataFrame:
    """A map for each user: breaks at their events of a kind, offsets by the events' values."""
    events = _table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return events.select("user_id", F.col("event_id").alias("source"), (F.col("event_id") + sign * F.floor("value").cast("bigint")).alias("target"))


@query(
    "q_rift_map",
    f"""WITH a AS (SELECT *, target - source AS off FROM ({_MAP_A})),
l AS (SELECT user_id, arg_max(off, source) AS last_off, bool_or(source = 0) AS has_zero FROM a GROUP BY user_id)
SELECT e.event_id, CAST(coalesce(a.off, 0) AS BIGINT) AS zero_rule, CAST(coalesce(a.off, l.last_off, 0) AS BIGINT) AS wrapping_rule,
  CAST(coalesce(a.off, l.last_off, 0) AS BIGINT) AS head_rule
FROM events e ASOF LEFT JOIN a ON a.user_id = e.user_id AND a.source <= e.event_id LEFT JOIN l ON l.user_id = e.user_id""",
)
def q_rift_map(spark, sf_dir):
    entries = _map(spark, sf_dir, "purchase", 1)
    probes = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return rifts.lookups(probes, entries, ["user_id"], "event_id", {f"{rule}_rule": rule for rule in ("zero", "wrapping", "head")}).drop("user_id")


@query(
    "q_rift_sum",
    f"""WITH a AS (SELECT *, target - source AS off FROM ({_MAP_A})), b AS (SELECT *, target - source AS off FROM ({_MAP_B})),
la AS (SELECT user_id, arg_max(off, source) AS l FROM a GROUP BY 1), lb AS (SELECT user_id, arg_max(off, source) AS l FROM b GROUP BY 1),
s AS (SELECT user_id, source FROM a UNION SELECT user_id, source FROM b),
o AS (SELECT s.user_id, s.source, coalesce(a.off, la.l, 0) + coalesce(b.off, lb.l, 0) AS off, la.l IS NOT NULL AND lb.l IS NOT NULL AS both_
  FROM s ASOF LEFT JOIN a ON a.user_id = s.user_id AND a.source <= s.source ASOF LEFT JOIN b ON b.user_id = s.user_id AND b.source <= s.source
  LEFT JOIN la ON la.user_id = s.user_id LEFT JOIN lb ON lb.user_id = s.user_id),
w AS (SELECT *, lag(off) OVER (PARTITION BY user_id ORDER BY source) AS before FROM o)
SELECT user_id, source, CAST(source + off AS BIGINT) AS target FROM w WHERE NOT both_ OR before IS NULL OR before <> off""",
)
def q_rift_sum(spark, sf_dir):
    return rifts.total(_map(spark, sf_dir, "purchase", 1), _map(spark, sf_dir, "signup", -1), ["user_id"])


@query(
    "q_rift_compose",
    f"""WITH a AS (SELECT *, target - source AS off, lead(source) OVER (PARTITION BY user_id ORDER BY source) AS e FROM ({_MAP_A})),
b AS (SELECT *, target - source AS off FROM ({_MAP_B})), lb AS (SELECT user_id, arg_max(off, source) AS l FROM b GROUP BY 1),
p AS (SELECT user_id, source, off FROM a UNION
  SELECT a.user_id, b.source - a.off, a.off FROM a JOIN b ON a.user_id = b.user_id AND b.source - a.off > a.source AND (a.e IS NULL OR b.source - a.off < a.e)),
i AS (SELECT user_id, source, source + off AS image FROM p)
SELECT i.user_id, i.source, CAST(i.image + coalesce(b.off, lb.l, 0) AS BIGINT) AS target
FROM i ASOF LEFT JOIN b ON b.user_id = i.user_id AND b.source <= i.image LEFT JOIN lb ON lb.user_id = i.user_id""",
)
def q_rift_compose(spark, sf_dir):
    return rifts.compose(_map(spark, sf_dir, "purchase", 1), _map(spark, sf_dir, "signup", -1), ["user_id"])


_COARSE = "SELECT user_id, event_id AS source, event_id + CAST(floor(value / 20) AS BIGINT) AS target FROM events"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select("user_id", F.col("event_id").alias("source"), (F.col("event_id") + F.floor(F.col("value") / 20).cast("bigint")).alias("target"))


@query(
    "q_rift_collapse",
    f"""WITH w AS (SELECT *, target - source AS off, lag(target - source) OVER (PARTITION BY user_id ORDER BY source) AS before FROM ({_COARSE})),
k AS (SELECT * FROM w WHERE before IS NULL OR before <> off),
e AS (SELECT user_id, count(*) AS n, min(source) AS lo, arg_min(off, source) AS a, arg_max(off, source) AS z FROM k GROUP BY 1)
SELECT user_id, CASE WHEN n = 1 THEN 0 ELSE source END AS source, CASE WHEN n = 1 THEN off ELSE target END AS target FROM k JOIN e USING (user_id)
WHERE CASE WHEN n = 1 THEN off <> 0 ELSE source <> lo OR a <> z END""",
)
def q_rift_collapse(spark, sf_dir):
    return rifts.shortened(_coarse(spark, sf_dir), ["user_id"])


@query("q_rift_vote")
def q_rift_vote(spark, sf_dir):
    """Maps of customers from suppliers to parts out of their order lines: a source's targets vote."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    entries = lines.select("o_custkey", F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"))
    entries = entries.withColumn("ord", F.to_json("line"))
    return rifts.reduced(entries, ["o_custkey"], drop_unset=True)


@query("q_rift_inverse")
def q_rift_inverse(spark, sf_dir):
    return rifts.inverse(_map(spark, sf_dir, "purchase", 1).withColumn("ord", F.col("source")), ["user_id"])


@query("q_io2rva", "SELECT 0 AS source, 0 AS target UNION ALL SELECT CAST(n_nationkey * 512 AS BIGINT), CAST(n_regionkey * 4096 + n_nationkey AS BIGINT) FROM nation WHERE n_nationkey <> 0 AND n_regionkey * 4096 + n_nationkey <> 0")
def q_io2rva(spark, sf_dir):
    return rifts.offsets_to_rvas(_sections(spark, sf_dir), [])


@query("q_section_map", "SELECT 0 AS source, 0 AS target UNION ALL SELECT CAST(n_regionkey * 4096 + n_nationkey AS BIGINT), CAST(min(n_nationkey * 512) AS BIGINT) FROM nation WHERE n_nationkey <> 0 AND n_regionkey * 4096 + n_nationkey <> 0 GROUP BY 1")
def q_section_map(spark, sf_dir):
    return rifts.section_map(_sections(spark, sf_dir), [])


# --- Lookups and matching -----------------------------------------------------------------------------------


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sections of an image."""
    key = F.col("n_nationkey")
    va = F.col("n_regionkey") * 4096 + key
    return _table(spark, sf_dir, "nation").select(
        key.alias("ord"), va.cast("bigint").alias("va"), (1500 + 100 * key).cast("bigint").alias("vsize"), (key * 512).cast("bigint").alias("raw"), F.lit(2048).cast("bigint").alias("raw_size")
    )


_SECTIONS = "SELECT n_nationkey AS ord, n_regionkey * 4096 + n_nationkey AS va, 1500 + 100 * n_nationkey AS vsize, n_nationkey * 512 AS raw, 2048 AS raw_size FROM nation"


@query(
    "q_section_lookup",
    f"""WITH s AS ({_SECTIONS}), p AS (SELECT o_orderkey, CAST(floor(o_totalprice / 20) AS BIGINT) AS rva FROM orders),
m AS (SELECT p.o_orderkey, p.rva, arg_min(s.ord, s.ord) AS ord, arg_min(s.raw + p.rva - s.va, s.ord) AS file_offset FROM p LEFT JOIN s ON p.rva >= s.va AND p.rva < s.va + greatest(s.vsize, s.raw_size) GROUP BY ALL)
SELECT o_orderkey, rva, ord, CAST(file_offset AS BIGINT) AS file_offset FROM m""",
)
def q_section_lookup(spark, sf_dir):
    probes = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 20).cast("bigint").alias("rva"))
    ranges = _sections(spark, sf_dir).withColumn("end", F.col("va") + F.greatest("vsize", "raw_size"))
    found = matching.containing(probes, ranges, "rva", "va", "end", "ord")
    offset = F.when(F.col("range.raw_size") > 0, F.col("range.raw") + F.col("rva") - F.col("range.va"))
    return found.select("o_orderkey", "rva", F.col("range.ord").alias("ord"), offset.alias("file_offset"))


@query("q_heap_map", f"WITH d AS ({_DOCS}), f AS (SELECT t, min(doc_id) AS target FROM d GROUP BY t) SELECT doc_id AS source, target FROM d JOIN f USING (t)")
def q_heap_map(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    return matching.first_of_value(docs, docs, "value", "doc_id")


@query(
    "q_triplet_fifo",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders)
SELECT a.o_orderkey AS source, b.o_orderkey AS target FROM o a JOIN o b USING (o_custkey, o_orderpriority, k) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""",
)
def q_triplet_fifo(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return matching.fifo(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query(
    "q_sequence_match",
    """WITH s AS (SELECT *, min(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS stop FROM orders WHERE o_orderstatus = 'F'),
o AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM s WHERE stop IS NULL OR o_orderkey < stop UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM o)
SELECT a.o_custkey AS owner, a.o_orderkey AS source, b.o_orderkey AS target FROM n a JOIN n b USING (o_custkey, o_orderpriority, k) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'""",
)
def q_sequence_match(spark, sf_dir):
    """Within each owner, each child in order to the first unused one of its name; a child that is mapped already ends its owner's list."""
    orders = _table(spark, sf_dir, "orders")
    source = orders.filter("o_orderstatus = 'F'").withColumn("mapped", F.pmod("o_orderkey", F.lit(11)) == 0)
    return matching.by_sequence(source, orders.filter("o_orderstatus = 'P'"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "q_list_ranges",
    """WITH s AS (SELECT n_nationkey, min(c_custkey) AS start FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
w AS (SELECT *, lead(start) OVER (ORDER BY n_nationkey) AS following, (SELECT count(*) FROM customer) + 1 AS stop_all FROM s)
SELECT n_nationkey, start AS first, CAST(CASE WHEN following IS NULL OR following = 0 OR following > stop_all THEN stop_all ELSE following END AS BIGINT) AS stop FROM w""",
)
def q_list_ranges(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    starts = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("start"))
    owners = _table(spark, sf_dir, "nation").select("n_nationkey").join(starts, "n_nationkey", "left")
    return matching.list_ranges(owners, "n_nationkey", "start", F.lit(customers.count())).select("n_nationkey", "first", "stop")


@query(
    "q_name_first_match",
    """WITH t AS (SELECT p_brand, min(p_partkey) AS target_partkey FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_partkey, p_brand, target_partkey FROM part JOIN t USING (p_brand) WHERE p_partkey <> target_partkey""",
)
def q_name_first_match(spark, sf_dir):
    """Parts to the first large part of their brand, where that is another."""
    parts = _table(spark, sf_dir, "part")
    targets = parts.filter("p_size > 25").select("p_brand", F.col("p_partkey").alias("partkey"))
    found = matching.first_match(parts.select("p_partkey", "p_brand"), targets, ["p_brand"], "partkey")
    return found.filter("p_partkey <> target_partkey")


@query(
    "q_reloc_pages",
    """WITH e AS (SELECT CAST(l_partkey * 37 + l_suppkey AS BIGINT) AS rva, CAST(l_linenumber AS BIGINT) AS kind FROM lineitem)
SELECT rva // 4096 AS page, count(*) AS entries, count(*) % 2 = 1 AS padded, 8 + 2 * (count(*) + count(*) % 2) AS size, min(rva % 4096) AS first, sum(kind * 4096 + rva % 4096)::BIGINT AS words FROM e GROUP BY 1""",
)
def q_reloc_pages(spark, sf_dir):
    """Relocation entries grouped into blocks by page, with a block's padding and size."""
    entries = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 37 + F.col("l_suppkey")).cast("bigint").alias("rva"), F.col("l_linenumber").cast("bigint").alias("kind"))
    return images.relocation_pages(entries, [])


@query(
    "q_coded_index_split",
    "SELECT l_orderkey, l_linenumber, (l_orderkey * 8 + l_linenumber % 8) & 7 AS tag, (l_orderkey * 8 + l_linenumber % 8) >> 3 AS rid, CASE (l_orderkey * 8 + l_linenumber % 8) & 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 26 WHEN 3 THEN 6 WHEN 4 THEN 27 END AS to_table FROM lineitem",
)
def q_coded_index_split(spark, sf_dir):
    """Coded indexes of the kind MemberRefParent, split into tag, table and row."""
    raw = F.col("l_orderkey") * 8 + F.pmod("l_linenumber", F.lit(8))
    tag, table, rid = images.coded_index(raw, "MemberRefParent")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tag.alias("tag"), rid.alias("rid"), table.alias("to_table"))


@query(
    "q_sections_by_name",
    """WITH s AS (SELECT n_regionkey AS image_id, left(n_name, 1) AS name, n_nationkey AS ord, n_regionkey * 4096 + n_nationkey AS va FROM nation),
t AS (SELECT (n_regionkey + 1) % 5 AS image_id, left(n_name, 1) AS name, arg_min(n_regionkey * 4096 + n_nationkey, n_nationkey) AS va FROM nation GROUP BY 1, 2)
SELECT image_id, CAST(s.va - 1 AS BIGINT) AS source, CAST(t.va - 1 AS BIGINT) AS target FROM s JOIN t USING (image_id, name)""",
)
def q_sections_by_name(spark, sf_dir):
    """Regions as images, nations as their sections: each to the first section of its name in the next image."""
    found = _sections(spark, sf_dir).join(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.left("n_name", F.lit(1)).alias("name"), "n_regionkey"), "ord")
    source = found.withColumn("image_id", F.col("n_regionkey"))
    return images.sections_by_name(source, found.withColumn("image_id", F.pmod(F.col("n_regionkey") + 1, F.lit(5))), ["image_id"])


# --- Matches ------------------------------------------------------------------------------------------------


@query(
    "q_symbol_histogram",
    f"SELECT CAST(('0x' || s) AS INT) AS symbol, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(t)), '..')) AS s FROM ({_DOCS})) GROUP BY 1",
)
def q_symbol_histogram(spark, sf_dir):
    """How often each byte occurs: counted per batch, then summed."""
    return matching.byte_histogram(_texts(spark, sf_dir), "content")


GRAM = 24


@query(
    "q_ngram_candidates",
    f"""WITH b AS (SELECT DISTINCT item_id, substr(t, i, {GRAM}) AS g FROM (SELECT item_id, coalesce(text, '') AS t, unnest(range(1, length(coalesce(text, '')) - {GRAM} + 2)) AS i FROM benchmark)),
d AS (SELECT DISTINCT doc_id, substr(t, i, {GRAM}) AS g FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(1, length(coalesce(text, '')) - {GRAM} + 2)) AS i FROM documents) WHERE substr(t, i, {GRAM}) IN (SELECT g FROM b))
SELECT doc_id, item_id, count(*) AS shared FROM b JOIN d USING (g) GROUP BY ALL""",
)
def q_ngram_candidates(spark, sf_dir):
    """Pairs of a document and a benchmark item with the distinct grams that both have: where copies can be found."""
    return matching.shared_grams(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), GRAM)


# --- Test runs ----------------------------------------------------------------------------------------------

@query(
    "q_case_matrix",
    "SELECT 'part' || CAST(p_partkey AS VARCHAR) || '.' || mode AS id, 'create_mode_sweep' AS category, version, options FROM part "
    "CROSS JOIN (VALUES ('raw', 'PA30', ''), ('bsdiff', 'PA30', 'bsdiff'), ('md5', 'PA30', 'md5'), ('sha256', 'PA30', 'sha256'), ('pa31', 'PA31', '')) m(mode, version, options)",
)
def q_case_matrix(spark, sf_dir):
    """Every input under every mode."""
    return cases.matrix(_table(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), F.lit("create_mode_sweep").alias("category")))


@query(
    "q_apply_bounded",
    "SELECT item_id, CASE WHEN strlen(t) <= 300 THEN md5(t) END AS digest, CASE WHEN strlen(t) > 300 THEN 'malformed' END AS error FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)",
)
def q_apply_bounded(spark, sf_dir):
    """Deltas of benchmark items applied into buffers of 300 bytes: those that do not fit are errors."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.lit(b"").alias("reference"), bytes_ops.utf8(F.coalesce("text", F.lit(""))).alias("target"))
    tried = jobs.try_apply_into(jobs.create(jobs.spread(items)), F.lit(300))
    return tried.select("item_id", F.md5("result").alias("digest"), "error")


_RESULTS = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' WHEN 'P' THEN 'EXC' END AS status, lower(substr(o_orderpriority, 3, 6)) AS dll,
  CASE WHEN o_totalprice < 250000 THEN 'ours_to_native' ELSE 'native_to_ours' END AS direction, 'cat' || CAST(c_nationkey AS VARCHAR) AS category,
  md5(CAST(o_custkey // 100 AS VARCHAR)) AS got_sha, o_custkey // 100 AS got_len,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Exception calling "X": "GetLastError=' || CAST(c_nationkey AS VARCHAR) || '"' WHEN c_mktsegment = 'MACHINERY' THEN 'Object reference not set to an instance'
    ELSE repeat(c_mktsegment, 12) END AS message
FROM orders JOIN customer ON c_custkey = o_custkey"""
_NORMAL = "CASE WHEN contains(message, 'GetLastError=') THEN regexp_extract(message, '(GetLastError=[^\"\\\\]*)', 1) WHEN contains(message, 'Object reference not set') THEN 'null-output (empty target)' ELSE left(message, 60) END"
_CLASSIFIED = f"""SELECT *, CASE WHEN status IS NULL THEN 'skipped' WHEN status IN ('PASS', 'OK') THEN 'pass' WHEN status = 'FAIL' THEN 'fail' ELSE 'error' END AS verdict,
  CASE WHEN status = 'FAIL' THEN 'got ' || left(got_sha, 12) || ' (' || CAST(got_len AS VARCHAR) || 'B)' WHEN status NOT IN ('PASS', 'OK', 'FAIL') THEN {_NORMAL} END AS detail FROM ({_RESULTS})"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of a test run: their customers give categories and messages."""
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").when(F.col("o_orderstatus") == "P", "EXC")
    length = F.floor(F.col("o_custkey") / 100)
    nation = F.col("c_nationkey").cast("string")
    message = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit('Exception calling "X": "GetLastError='), nation, F.lit('"')))
        .when(F.col("c_mktsegment") == "MACHINERY", "Object reference not set to an instance")
        .otherwise(F.repeat("c_mktsegment", F.lit(12)))
    )
    return rows.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.lower(F.substring("o_orderpriority", 3, 6)).alias("dll"),
        F.when(F.col("o_totalprice") < 250000, "ours_to_native").otherwise("native_to_ours").alias("direction"),
        F.concat(F.lit("cat"), nation).alias("category"), F.md5(length.cast("string")).alias("got_sha"), length.alias("got_len"), message.alias("message"),
    )


@query("q_normalize_error", f"SELECT id, {_NORMAL} AS error FROM ({_RESULTS})")
def q_normalize_error(spark, sf_dir):
    return _results(spark, sf_dir).select("id", report.normalised_error(F.col("message")).alias("error"))


@query("q_verdict_score", f"SELECT dll, direction, count(*) FILTER (verdict = 'pass') AS passed, count(*) AS total FROM ({_CLASSIFIED}) WHERE verdict <> 'skipped' GROUP BY ALL")
def q_verdict_score(spark, sf_dir):
    return report.scores(report.classified(_results(spark, sf_dir)), ["dll", "direction"])


@query(
    "q_failure_buckets",
    f"""SELECT direction || '|' || dll || '|' || category || '|' || upper(verdict) || ' ' || detail AS signature, count(*) AS failures,
  array_to_string(list(CAST(id AS VARCHAR) ORDER BY id)[1:5], ',') AS examples FROM ({_CLASSIFIED}) WHERE verdict IN ('fail', 'error') GROUP BY 1""",
)
def q_failure_buckets(spark, sf_dir):
    found = report.buckets(report.classified(_results(spark, sf_dir)), "id", "id")
    return found.withColumn("examples", F.array_join("examples", ","))


@query(
    "q_results_with_cases",
    f"""SELECT id, verdict, c_nationkey AS category FROM ({_CLASSIFIED}) r JOIN orders ON o_orderkey = r.id JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 20""",
)
def q_results_with_cases(spark, sf_dir):
    """Results with the category of their case; some cases are not known."""
    known = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").filter("c_nationkey < 20"), F.col("c_custkey") == F.col("o_custkey"))
    found = report.with_cases(report.classified(_results(spark, sf_dir)), known.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("category")))
    return found.select("id", "verdict", "category")


@query(
    "q_verdict_pivot",
    """WITH v AS (SELECT l_orderkey, 'dll' || CAST(l_linenumber AS VARCHAR) || '/' || CASE WHEN l_returnflag = 'N' THEN 'ours_to_native' ELSE 'native_to_ours' END AS k,
  CASE WHEN l_linestatus = 'O' THEN 'pass' WHEN l_returnflag = 'R' THEN 'fail' ELSE 'error' END AS verdict FROM lineitem), w AS (SELECT l_orderkey, k, min(verdict) AS verdict FROM v GROUP BY 1, 2)
SELECT l_orderkey, string_agg(k || '=' || verdict, ',' ORDER BY k) AS verdicts FROM w GROUP BY 1""",
)
def q_verdict_pivot(spark, sf_dir):
    """Order lines as results: one row an order, with the verdict of each of its lines."""
    status = F.when(F.col("l_linestatus") == "O", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("EXC")
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("dll"), F.col("l_linenumber").cast("string")).alias("dll"),
        F.when(F.col("l_returnflag") == "N", "ours_to_native").otherwise("native_to_ours").alias("direction"), report.verdict(status).alias("verdict"),
    )
    entries = F.map_entries("verdicts")
    return report.pivoted(rows, "l_orderkey").select("l_orderkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("verdicts"))


@query(
    "q_min_repro",
    f"""WITH d AS (SELECT doc_id, strlen(t) AS n FROM ({_DOCS}) WHERE strlen(t) > 8),
c AS (SELECT doc_id, n, unnest([n * 7 // 8, n * 3 // 4, n // 2, n // 4, n // 8, n * 3 // 4, n // 2, n - n // 2, n - n // 4]) AS l FROM d)
SELECT doc_id, min(l) AS shortest, count(DISTINCT l) AS candidates FROM c WHERE l >= 8 AND l < n GROUP BY 1""",
)
def q_min_repro(spark, sf_dir):
    """Smaller inputs of each document, and the shortest."""
    found = report.shrink_candidates(_texts(spark, sf_dir), "doc_id", "content")
    return found.groupBy("doc_id").agg(F.min("length").cast("bigint").alias("shortest"), F.count("*").alias("candidates"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
