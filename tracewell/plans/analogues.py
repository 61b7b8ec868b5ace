"""The operators applied to the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import files, paths
from ..operators import relational as rel
from ..sinks import ewf
from ..sources import devices
from . import capture, evidence, health

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        _SQL[f.__name__] = sql
        return f

    return add


_TOP = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders"


@_query(f"SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM (SELECT * FROM ({_TOP}) WHERE rn <= 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15)")
def recent_topk_cap(t) -> DataFrame:
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return rel.recent_files(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", newest).select("o_custkey", "o_orderkey", "rank")


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_user(t) -> DataFrame:
    return rel.latest_by(t("events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@_query("SELECT min(v) AS start, count(*) AS count FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT l_orderkey AS v FROM lineitem)) GROUP BY g")
def bad_range_islands(t) -> DataFrame:
    return rel.islands(t("lineitem"), "l_orderkey", 1 << 12)


@_query("WITH p AS (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_totalprice > 200000) SELECT k, o_orderkey, c_name FROM p LEFT JOIN customer ON c_custkey = k UNION ALL SELECT c_custkey, NULL, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM p)")
def users_profile_account(t) -> DataFrame:
    profiles = t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return rel.with_leftovers(profiles, t("customer").select(F.col("c_custkey").alias("k"), "c_name"), "k").select("k", "o_orderkey", "c_name")


@_query("WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT - n_chars AS start FROM documents), p AS (SELECT o_orderkey, o_orderkey * 97 AS pos FROM orders) SELECT o_orderkey, doc_id, pos - start AS inside FROM p JOIN s ON pos >= start AND pos < start + n_chars")
def offset_to_segment(t) -> DataFrame:
    segments = rel.running_offset(t("documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    points = t("orders").select("o_orderkey", (F.col("o_orderkey") * 97).alias("pos"))
    return rel.locate(points, "pos", segments, "start", "n_chars").select("o_orderkey", "doc_id", (F.col("pos") - F.col("start")).alias("inside"))


@_query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def row_hashes(t) -> DataFrame:
    return t("documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@_query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'attention' ELSE 'clear' END AS verdict FROM events GROUP BY user_id")
def verdict(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "error"), "attention").otherwise("clear").alias("verdict"))


@_query("WITH n AS (SELECT user_id, event_id, lag(event_id) OVER w AS e1, lag(value) OVER w AS v1, first(event_id) OVER r AS e0, first(value) OVER r AS v0, count(*) OVER r AS c, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)) SELECT event_id, round((value - CASE WHEN c = 1 THEN v1 ELSE v0 END) / nullif(event_id - CASE WHEN c = 1 THEN e1 ELSE e0 END, 0), 6) AS rate FROM n")
def trailing_window(t) -> DataFrame:
    return rel.trailing_rate(t("events"), "user_id", "event_id", "value", 300).select("event_id", F.round("rate", 6).alias("rate"))


_NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'Desktop.INI' WHEN 1 THEN 'NTUSER.DAT.LOG' WHEN 2 THEN '~$' || p_name WHEN 3 THEN p_name || '.TMP' WHEN 4 THEN p_name || '.regtrans-ms' WHEN 5 THEN 'thumbs.db.bak' ELSE p_name || '.docx' END"


@_query(f"SELECT p_partkey, name FROM (SELECT p_partkey, p_size, {_NAMES} AS name FROM part) WHERE p_partkey >= 24 AND p_size <> 3 AND NOT (lower(name) IN ('desktop.ini','thumbs.db','ntuser.dat','ntuser.ini','ntuser.pol','usrclass.dat','iconcache.db') OR regexp_matches(lower(name), '^(ntuser[.]dat|usrclass[.]dat|~[$]|~wr)') OR regexp_matches(lower(name), '[.](tmp|lock|log1|log2|regtrans-ms|blf|etl)$'))")
def noise_filter(t) -> DataFrame:
    named = t("part").select("p_partkey", F.when(F.col("p_size") != 3, F.col("p_size")).alias("time"), F.expr(_NAMES).alias("name"))
    return named.where(files.is_user_file(F.col("name"), F.col("p_partkey"), F.col("time"))).select("p_partkey", "name")


@_query("SELECT user_id, max(ts) AS last_login FROM events WHERE event_type = 'signup' AND user_id > 0 GROUP BY user_id")
def last_login(t) -> DataFrame:
    return t("events").where("event_type = 'signup' AND user_id > 0").groupBy("user_id").agg(F.max("ts").alias("last_login"))


@_query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer WHERE regexp_full_match(split_part(c_name, '#', 2), '[0-9]+') AND CAST(split_part(c_name, '#', 2) AS BIGINT) BETWEEN 10 AND 1000")
def login_line_parse(t) -> DataFrame:
    p = t("customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("kind"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("n"))
    number = F.when(F.col("n").rlike("^[0-9]+$"), F.col("n").try_cast("long"))
    return p.withColumn("number", number).where(F.col("number").between(10, 1000)).select("c_custkey", "kind", "number")


_WATCH = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in health.WATCHED.items()) + ") AS w(id, label)"


@_query(f"SELECT event_id, id, label, event_id % 3 AS value, event_id % 3 > 0 AS flag FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) * 3 % 200 AS id FROM events) JOIN {_WATCH} USING (id)")
def smart_flags(t) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    values = t("events").select("event_id", (k * 3 % 200).cast("int").alias("id"), (F.col("event_id") % 3).alias("value"))
    return health.flagged(values, health.watch_list(values.sparkSession), "id", "value").select("event_id", "id", "label", "value", "flag")


_ATTRIBUTES = "list_filter([{'id': 5, 'name': 'Reallocated sectors', 'value': a}, {'id': 197, 'name': 'Current pending sectors', 'value': b}], lambda x: x.value > 0)"


@_query(f"WITH d AS (SELECT event_id, (event_id % 5)::BIGINT AS a, (event_id % 2)::BIGINT AS b FROM events), r AS (SELECT event_id, list_concat(CASE WHEN event_id % 7 = 0 THEN ['SMART overall health self-assessment: FAILED'] ELSE [] END, list_transform({_ATTRIBUTES}, lambda x: x.name || ': ' || x.value)) AS bad FROM d) SELECT event_id, CASE WHEN len(bad) > 0 THEN 'attention' ELSE 'clear' END AS verdict, len(bad)::BIGINT AS defects, array_to_string(bad, '; ') AS issues FROM r")
def smart_documents(t) -> DataFrame:
    raw = lambda i, v: F.struct(F.lit(i).alias("id"), F.struct(v.alias("value")).alias("raw"))
    e = F.col("event_id")
    table = F.struct(F.array(raw(5, e % 5), raw(9, e), raw(197, e % 2)).alias("table"))
    document = F.to_json(F.struct(F.struct((e % 7 != 0).alias("passed")).alias("smart_status"), table.alias("ata_smart_attributes")))
    found = health.findings_of(health.read(t("events").select(e.cast("string").alias("device"), document.alias("document"))))
    issues = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == "bad", F.struct("seq", "detail")))), lambda x: x["detail"]), "; ")
    per = found.groupBy("device").agg(F.count_if(F.col("level") == "bad").alias("defects"), issues.alias("issues"))
    return health.verdicts(found, "device").join(per, "device").select(F.col("device").cast("long").alias("event_id"), "verdict", "defects", "issues")


#: A volume's first bytes, by what they are taken for: marks at places; the mark "far" stands at 0x10040.
_MARKS: list[tuple[str, dict]] = [
    ("NTFS", {3: b"NTFS    "}), ("BitLocker", {3: b"-FVE-FS-"}), ("exFAT", {3: b"EXFAT   "}), ("ReFS", {3: b"ReFS\0\0\0\0"}), ("FAT32", {82: b"FAT32   "}), ("FAT", {54: b"FAT16"}),
    ("LUKS", {0: b"LUKS\xba\xbe"}), ("XFS", {0: b"XFSB"}), ("APFS", {32: b"NXSB"}), ("LVM", {512: b"LABELONE"}), ("ext2", {1080: b"\x53\xef"}), ("ext3", {1080: b"\x53\xef", 1116: b"\x04"}),
    ("ext4", {1080: b"\x53\xef", 1116: b"\x04", 1120: b"\x40"}), ("HFS+", {1024: b"H+"}), ("swap", {4086: b"SWAPSPACE2"}), ("Btrfs", {"far": b"_BHRfS_M"}), ("unknown", {}),
    # The first mark that fits counts.
    ("NTFS", {3: b"NTFS    ", 82: b"FAT32   ", 1080: b"\x53\xef"}), ("LUKS", {0: b"LUKS\xba\xbe", 4086: b"SWAPSPACE2", "far": b"_BHRfS_M"}),
]


def _head(marks: dict) -> bytearray:
    out = bytearray(4096)
    for at, mark in marks.items():
        if at != "far":
            out[at : at + len(mark)] = mark
    return out


@_query("SELECT p_partkey, CASE p_partkey % 19 " + " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(_MARKS)) + " END AS fs FROM part")
def signature_case(t) -> DataFrame:
    rows = [(k, _head(marks), bytearray(marks.get("far", bytes(8)))) for k, (_, marks) in enumerate(_MARKS)]
    part = t("part").select("p_partkey", (F.col("p_partkey") % len(_MARKS)).cast("int").alias("k"))
    heads = part.sparkSession.createDataFrame(rows, "k int, head binary, far binary")  # a fixed table
    return part.join(F.broadcast(heads), "k").select("p_partkey", evidence.file_system(F.col("head"), F.col("far")).alias("fs"))


@_query("SELECT o_orderkey, greatest(0, least(o_custkey * 10, 5000 - o_orderkey)) AS size FROM orders")
def partition_clamp(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.greatest(F.lit(0).cast("long"), F.least(F.col("o_custkey") * 10, F.lit(5000) - F.col("o_orderkey"))).alias("size"))


@_query("WITH m AS (SELECT max(l_orderkey) * 1000003 * 1000 AS m FROM lineitem) SELECT DISTINCT p AS pos FROM (SELECT (m::HUGEINT * i // 511 // 16 * 16)::BIGINT AS p FROM m, (SELECT unnest(range(512)) AS i) UNION ALL SELECT 0 UNION ALL SELECT m // 16 * 16 FROM m)")
def sample_offsets(t) -> DataFrame:
    last = t("lineitem").agg((F.max("l_orderkey") * 1000003 * 1000).alias("m"))
    return capture.sample_offsets(last, "m", 512, 16)


@_query("SELECT l_suppkey, l_orderkey, l_linenumber, coalesce(lead(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey), 1000000) AS ends FROM lineitem")
def chunk_end_lead(t) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.coalesce(F.lead("l_orderkey").over(w), F.lit(1000000)).alias("ends"))


@_query("SELECT user_id, event_type AS stage FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1")
def bottleneck(t) -> DataFrame:
    return capture.bottleneck(t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "event_type", "n")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_discount, 0), 4) AS eta FROM lineitem")
def eta_speed(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.try_divide("l_extendedprice", "l_discount"), 4).alias("eta"))


def _size_sql(base: int, places: int) -> str:
    n, i = "(l_partkey * 123457)", "i" if base == 1024 else ""
    cases = " ".join(f"WHEN {n} < {base ** (k + 1)} THEN printf('%.{places}f {u}', {n} / {float(base**k)})" for k, u in ((1, f"K{i}B"), (2, f"M{i}B"), (3, f"G{i}B")))
    return f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {n} < {base} THEN printf('%d B', {n}) {cases} ELSE printf('%.{places}f T{i}B', {n} / {float(base**4)}) END AS size_text FROM lineitem"


def _sized(t, base: int, places: int) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.size_text(F.col("l_partkey") * 123457, base, places).alias("size_text"))


@_query(_size_sql(1000, 1))
def bytes_fmt_1000(t) -> DataFrame:
    return _sized(t, 1000, 1)


@_query(_size_sql(1024, 2))
def bytes_fmt_1024(t) -> DataFrame:
    return _sized(t, 1024, 2)


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS at FROM events")
def iso_ts(t) -> DataFrame:
    return t("events").select("event_id", scalars.iso(F.col("ts")).alias("at"))


@_query("SELECT DISTINCT l_orderkey, strftime(make_timestamp(((l_orderkey * 1000000000000 + 7 * l_orderkey + 9) // 10)::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS at FROM lineitem")
def filetime_ts(t) -> DataFrame:
    ft = F.col("l_orderkey") * 1000000000000 + F.col("l_orderkey") * 7 + 9 + scalars.FILETIME_EPOCH
    return t("lineitem").select("l_orderkey").distinct().select("l_orderkey", scalars.micros_text(scalars.filetime(ft)).alias("at"))


@_query("SELECT event_id, 'UTC' || CASE WHEN b > 0 THEN '-' ELSE '+' END || lpad((abs(b) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(b) % 60)::VARCHAR, 2, '0') AS zone FROM (SELECT event_id, event_id % 1440 - 720 AS b FROM events)")
def utc_offset(t) -> DataFrame:
    b = F.col("event_id") % 1440 - 720
    return t("events").select("event_id", scalars.utc_offset(F.when(b < 0, b + (1 << 32)).otherwise(b)).alias("zone"))


@_query("SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 99 THEN 'E' || lpad(p_partkey::VARCHAR, 2, '0') WHEN p_partkey BETWEEN 100 AND 14971 THEN chr((69 + (p_partkey - 100) // 676)::INT) || chr((65 + (p_partkey - 100) // 26 % 26)::INT) || chr((65 + (p_partkey - 100) % 26)::INT) END AS ext FROM part")
def segment_ext(t) -> DataFrame:
    return t("part").select("p_partkey", scalars.segment_extension(F.col("p_partkey")).alias("ext"))


@_query("SELECT 'bad' AS level, event_id AS id, 0 AS seq FROM events WHERE event_type = 'error' UNION ALL SELECT 'info', doc_id, 1 FROM documents WHERE n_chars < 100 UNION ALL SELECT 'ok', page_id, 2 FROM pages")
def findings_union(t) -> DataFrame:
    row = lambda level, c: [F.lit(level).alias("level"), F.col(c).alias("id")]
    return rel.findings([t("events").where("event_type = 'error'").select(*row("bad", "event_id")), t("documents").where("n_chars < 100").select(*row("info", "doc_id")), t("pages").select(*row("ok", "page_id"))])


@_query("SELECT r_name AS name, r_regionkey AS disk, 'disk' AS kind FROM region UNION ALL SELECT n_name, n_regionkey, 'partition' FROM nation")
def device_tree(t) -> DataFrame:
    return t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("disk"), F.lit("disk").alias("kind")).unionByName(t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("disk"), F.lit("partition").alias("kind")))


@_query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct_ips(t) -> DataFrame:
    first = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


_RECORDED = "CASE WHEN doc_id % 97 = 0 THEN md5(text || '.') WHEN doc_id % 5 = 0 THEN upper(md5(text)) ELSE md5(text) END"


@_query("SELECT source, n - wrong = n AS matched, n AS digests, wrong FROM (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 97 = 0 OR doc_id % 89 = 0) AS wrong FROM documents GROUP BY source)")
def hash_verify(t) -> DataFrame:
    """Of digests recorded beforehand some are of other texts, and some weren't computed again: both don't match."""
    recorded = t("documents").select("doc_id", "source", F.expr(_RECORDED).alias("recorded"))
    found = t("documents").where("doc_id % 89 <> 0").select("doc_id", F.md5("text").alias("found"))
    matched = capture.matches(recorded, found, ["doc_id"])
    wrong = matched.groupBy("source").agg(F.count_if(~F.col("match")).alias("wrong"))
    return capture.all_match(matched, ["source"]).join(wrong, "source").select("source", "matched", "digests", "wrong")


_FOLDER = "'\\' || CASE c_custkey % 5 WHEN 0 THEN 'Users\\' || c_name || '\\AppData\\Local' WHEN 1 THEN 'Users\\' || c_name || '\\Documents' WHEN 2 THEN 'Users\\Default\\x' WHEN 3 THEN 'Windows\\Temp' ELSE 'USERS\\' || c_name END"


@_query(f"SELECT c_custkey, folder FROM (SELECT c_custkey, {_FOLDER} AS folder FROM customer) WHERE c_custkey % 5 IN (1, 4)")
def user_path_filter(t) -> DataFrame:
    name, k = F.col("c_name"), F.col("c_custkey") % 5
    folder = F.when(k == 0, F.concat(F.lit("\\Users\\"), name, F.lit("\\AppData\\Local"))).when(k == 1, F.concat(F.lit("\\Users\\"), name, F.lit("\\Documents"))).when(k == 2, "\\Users\\Default\\x").when(k == 3, "\\Windows\\Temp").otherwise(F.concat(F.lit("\\USERS\\"), name))
    return t("customer").select("c_custkey", folder.alias("folder")).where(files.is_user_path(F.col("folder")))


_SID = "CASE c_custkey % 4 WHEN 0 THEN 'S-1-5-21-7-8-9-' || c_custkey WHEN 1 THEN 'S-1-12-1-5-' || c_custkey WHEN 2 THEN 'S-1-5-18' ELSE 'S-1-5-80-x' END"


@_query(f"SELECT c_custkey, {_SID} AS sid, CASE c_custkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'Microsoft Entra ID' ELSE 'other' END AS class, CASE WHEN c_custkey % 4 < 2 THEN c_custkey WHEN c_custkey % 4 = 2 THEN 18 ELSE -1 END AS rid, c_custkey % 4 <> 2 AS profile FROM customer")
def account_class(t) -> DataFrame:
    sid = F.col("sid")
    return t("customer").select("c_custkey", F.expr(_SID).alias("sid")).select("c_custkey", "sid", scalars.account_type(sid).alias("class"), F.coalesce(scalars.rid(sid), F.lit(-1)).alias("rid"), files.is_profile_sid(sid).alias("profile"))


@_query("WITH q AS (SELECT page_id, string_split(split_part(split_part(url, '#', 1), '?', 2), '&') AS p FROM pages), i AS (SELECT page_id, p, unnest(range(len(p))) AS k FROM q), e AS (SELECT page_id, k, p[k + 1] AS pair FROM i) SELECT page_id, split_part(pair, '=', 1) AS name, arg_max(substr(pair, strpos(pair, '=') + 1), k) AS value FROM e WHERE strpos(pair, '=') > 1 GROUP BY ALL")
def kv_parse(t) -> DataFrame:
    query = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    return rel.key_values(t("pages").select("page_id", query.alias("query")), "page_id", "query", "&").select("page_id", "name", "value")


@_query("SELECT name, kind, row_number() OVER (ORDER BY kind <> 'dir', lower(name), name) AS rank FROM (SELECT r_name AS name, 'dir' AS kind FROM region UNION ALL SELECT n_name, 'file' FROM nation)")
def dirs_first_sort(t) -> DataFrame:
    rows = t("region").select(F.col("r_name").alias("name"), F.lit("dir").alias("kind")).unionByName(t("nation").select(F.col("n_name").alias("name"), F.lit("file").alias("kind")))
    return rel.dirs_first(rows, "name", "kind")


@_query("WITH RECURSIVE p AS (SELECT conv_id, turn, role AS path FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, p.path || '/' || c.role FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 WHERE c.turn < 64) SELECT conv_id, turn, path FROM p")
def path_recursive(t) -> DataFrame:
    turns = t("conversations").select("conv_id", "turn", "role", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("before"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("same"))
    return paths.resolve(turns, ["conv_id", "turn"], ["same", "before"], "role")


@_query("SELECT p_partkey, CASE WHEN p_size * 1000 >= 22000 THEN 'Windows 11 ' || p_brand ELSE 'Windows 10 ' || p_brand END AS name, CASE WHEN p_partkey % 3 = 0 THEN (p_size * 1000)::VARCHAR ELSE (p_size * 1000)::VARCHAR || '.' || p_partkey END AS build FROM part")
def windows_names(t) -> DataFrame:
    build, ubr = (F.col("p_size") * 1000).cast("string"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey"))
    return t("part").select("p_partkey", scalars.product_name(F.concat(F.lit("Windows 10 "), "p_brand"), build).alias("name"), scalars.build_text(build, ubr).alias("build"))


@_query("SELECT c_custkey, '\\Users\\' || c_name AS inner_path, c_name AS folder FROM customer")
def volume_paths(t) -> DataFrame:
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    path = F.when(k == 0, F.concat(F.lit("C:\\Users\\"), name)).when(k == 1, F.concat(F.lit("%SystemDrive%\\Users\\"), name, F.lit("\\"))).otherwise(F.concat(F.lit("\\Users\\"), name))
    inner = scalars.volume_path(path)
    return t("customer").select("c_custkey", inner.alias("inner_path"), scalars.last_part(inner, "\\").alias("folder"))


@_query("SELECT c_custkey, 'u' || c_custkey AS username, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE (c_custkey * 7)::INT END AS uid, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS full_name, c_custkey % 5 = 0 AS disabled, c_custkey % 4 = 0 AS admin FROM customer WHERE (c_custkey % 4 = 0 OR c_custkey * 7 BETWEEN 1000 AND 59999) AND c_custkey % 11 <> 0")
def login_accounts(t) -> DataFrame:
    """Lines of a passwd file made from customers: some without a number, or with too few fields."""
    k = F.col("c_custkey")
    uid = F.when(k % 11 == 0, "x").otherwise(F.when(k % 4 == 0, F.lit(0)).otherwise(k * 7).cast("string"))
    gecos = F.when(k % 3 == 0, ",,").otherwise(F.concat("c_name", F.lit(",room,,")))
    line = F.concat_ws(":", F.concat(F.lit("u"), k.cast("string")), F.lit("x"), uid, F.lit("1"), gecos, F.lit("/home/u"), F.when(k % 5 == 0, "/usr/sbin/nologin").otherwise("/bin/sh"))
    out = files.login_accounts(t("customer").select("c_custkey", line.alias("line")), "line")
    return out.select("c_custkey", "username", "uid", "full_name", "disabled", (F.col("uid") == 0).alias("admin"))


@_query("SELECT o_custkey % 50 AS file, 'K' || (o_orderkey % 6) AS name, arg_max(o_orderstatus || ' ' || o_orderkey, o_orderkey) AS value FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL")
def settings_parse(t) -> DataFrame:
    """Lines name=value in three ways of quoting, and comments; the last of equal names counts."""
    k, value = F.col("o_orderkey"), F.concat_ws(" ", "o_orderstatus", F.col("o_orderkey").cast("string"))
    quoted = F.when(k % 3 == 0, F.concat(F.lit('"'), value, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("'"), value, F.lit("'"))).otherwise(value)
    line = F.concat(F.when(k % 7 == 0, "  # ").otherwise(" "), F.lit("K"), (k % 6).cast("string"), F.lit(" = "), quoted)
    return files.settings(t("orders").select((F.col("o_custkey") % 50).alias("file"), line.alias("line"), F.col("o_orderkey").alias("no")), ["file"], "line", "no")


@_query("SELECT o_orderkey, o_orderkey * 65537 AS number, o_orderkey * 4294967296 + o_custkey AS joined, ((o_orderkey - 1) // 128) AS \"group\", (o_orderkey - 1) % 128 AS place, (o_orderkey + 511) // 512 AS blocks, o_orderkey // 16 * 16 AS aligned FROM orders WHERE o_orderkey > 0")
def binary_numbers(t) -> DataFrame:
    n, k = F.col("o_orderkey") * 65537, F.col("o_orderkey")
    raw = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8))))
    at = scalars.inode_place(k, F.lit(128))
    return t("orders").where("o_orderkey > 0").select("o_orderkey", scalars.signed_long(scalars.little_endian(raw, 0, 8)).alias("number"), scalars.joined_number(k, F.col("o_custkey")).alias("joined"), at["group"].alias("group"), at["place"].alias("place"), scalars.blocks(k, 512).alias("blocks"), scalars.aligned(k, 16).alias("aligned"))


@_query("WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice, (o_orderkey * 13)::BIGINT AS n FROM orders) SELECT o_orderkey, printf('%.1f MB/s', o_totalprice * 1000 / 1e6) AS speed, CASE WHEN n < 3600 THEN printf('%dm %02ds', n // 60, n % 60) ELSE printf('%dh %02dm %02ds', n // 3600, n // 60 % 60, n % 60) END AS took, CASE WHEN o_orderkey % 10 = 0 THEN '-' ELSE strftime(make_timestamp(n * 1000000), '%Y-%m-%d %H:%M:%S UTC') END AS at, round(2 + 96.0 * (o_orderkey % 9) / 9, 6) AS percent FROM s WHERE n > 0")
def report_texts(t) -> DataFrame:
    n, k = F.col("o_orderkey") * 13, F.col("o_orderkey")
    return t("orders").where("o_orderkey > 0").select("o_orderkey", scalars.speed_text(F.col("o_totalprice") * 1000).alias("speed"), scalars.duration_text(n).alias("took"), scalars.time_text(F.when(k % 10 == 0, 0).otherwise(n)).alias("at"), F.round(scalars.progress(k % 9, F.lit(9)), 6).alias("percent"))


@_query("SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped, trim(translate(coalesce(html, ''), chr(9) || chr(10) || chr(13), '   '), ' ') AS line FROM pages")
def escaped_text(t) -> DataFrame:
    return t("pages").select("page_id", scalars.escaped(F.col("html")).alias("escaped"), scalars.one_line(F.coalesce("html", F.lit(""))).alias("line"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS zone, CASE WHEN n_nationkey % 3 = 0 THEN '6.8.' || n_nationkey END AS kernel, CASE n_nationkey % 5 WHEN 0 THEN '/dev/pd' || n_nationkey WHEN 1 THEN 'C:' WHEN 2 THEN '/dev/nvme0n1' WHEN 3 THEN '/dev/sda' ELSE '/dev/disk' || n_nationkey END AS device FROM nation")
def system_names(t) -> DataFrame:
    k, number = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    link = F.concat(F.when(k % 2 == 0, "../usr/share/zoneinfo/").otherwise("/etc/"), "n_name")
    name = F.concat(F.when(k % 3 == 0, "vmlinuz-6.8.").otherwise("initrd.img-6.8."), number)
    device = F.when(k % 5 == 0, F.concat(F.lit("\\\\.\\PHYSICALDRIVE"), number)).when(k % 5 == 1, "\\\\.\\C:").when(k % 5 == 2, "/dev/nvme0n1p3").when(k % 5 == 3, "/dev/sda2").otherwise(F.concat(F.lit("/dev/rdisk"), number, F.lit("s1")))
    return t("nation").select("n_nationkey", scalars.zone_of_link(link).alias("zone"), scalars.kernel_version(name).alias("kernel"), scalars.device_argument(device).alias("device"))


@_query("SELECT path, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS mountpoints, bool_or(c_mktsegment = 'MACHINERY') AS system FROM (SELECT '/dev/' || c_nationkey AS path, c_mktsegment FROM customer) GROUP BY path")
def device_mounts(t) -> DataFrame:
    rows = t("customer").select(F.concat(F.lit("/dev/"), F.col("c_nationkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("mountpoint"))
    own = devices.with_mounts(rows.select("path").distinct().withColumn("parent", F.lit(None).cast("string")), rows)
    return devices.with_system(own, ["machinery"]).select("path", F.array_join("mountpoints", ",").alias("mountpoints"), "system")


@_query("SELECT (SELECT count(*) FROM region) AS physical, (SELECT count(*) FROM nation) AS logical")
def device_counts(t) -> DataFrame:
    rows = t("region").select(F.lit("disk").alias("kind")).unionByName(t("nation").select(F.lit("partition").alias("kind")))
    return devices.counts(rows)


@_query("SELECT user_id, array_to_string(list_filter(['md5', 'sha1', 'sha256'], lambda x: list_contains(r, x)), ',') AS chosen, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(['md5', 'sha1', 'sha256'], x))), ',') AS unknown FROM (SELECT user_id, list(DISTINCT CASE event_type WHEN 'view' THEN 'sha256' WHEN 'click' THEN 'md5' ELSE event_type END) AS r FROM events WHERE event_id % 29 < 5 GROUP BY user_id)")
def chosen_hashes(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "sha256").when(F.col("event_type") == "click", "md5").otherwise(F.col("event_type"))
    r = t("events").where("event_id % 29 < 5").groupBy("user_id").agg(F.collect_set(kind).alias("r"))
    known = F.array(*map(F.lit, capture.HASHES))
    return r.select("user_id", F.array_join(F.array_intersect(known, "r"), ",").alias("chosen"), F.array_join(F.array_sort(F.array_except("r", known)), ",").alias("unknown"))


@_query("SELECT l_orderkey AS lba, row_number() OVER (ORDER BY l_orderkey) - 1 AS number FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def distinct_sorted(t) -> DataFrame:
    from ..operators.scans import numbered

    return numbered(t("lineitem").select(F.col("l_orderkey").alias("lba")).distinct(), [F.col("lba")])


@_query("SELECT c_custkey, coalesce(o.name, c_name) AS owner, coalesce(last, -1) AS last FROM customer LEFT JOIN (SELECT o_custkey, 'user' || o_custkey AS name, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) o ON o_custkey = c_custkey")
def owner_or_folder(t) -> DataFrame:
    roots = rel.latest_by(t("orders").where("o_totalprice > 300000"), "o_custkey", ["o_orderkey"], []).select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("last"))
    return t("customer").select("c_custkey", "c_name").join(roots, "c_custkey", "left").select("c_custkey", F.coalesce("name", "c_name").alias("owner"), F.coalesce("last", F.lit(-1)).alias("last"))


@_query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.other) AS name, coalesce(b.n, 0) AS n FROM (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT o_custkey AS k, 'order' AS other, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey) b ON a.k = b.k")
def names_and_numbers(t) -> DataFrame:
    """A full join of what two lists know of the same numbers; the first list's name wins."""
    a = t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_name")
    b = t("orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.lit("order").alias("other"))
    return a.join(b, "k", "full").select("k", F.coalesce("c_name", "other").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))


@_query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def global_latest(t) -> DataFrame:
    return rel.recent_files(t("events"), "user_id", [F.desc("ts"), F.desc("event_id")], total=1).select("event_id", "user_id")


_BYTES = "WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), l AS (SELECT doc_id, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS b FROM b)"


@_query(f"{_BYTES} SELECT doc_id, ((len(b) + coalesce(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521)::BIGINT AS adler FROM l")
def adler32_rows(t) -> DataFrame:
    import zlib

    adler = F.udf(lambda raw: zlib.adler32(raw), "long", useArrow=True)
    return t("documents").select("doc_id", adler(F.coalesce("text", F.lit("")).cast("binary")).alias("adler"))


def _without_sql(f):
    _Q[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    return f


@_without_sql
def compress_ratio(t) -> DataFrame:
    """DuckDB has no zlib; tests hold the rows against plain zlib."""
    ratio = F.udf(ewf.sample_ratio, "double", useArrow=True)
    return t("documents").select("doc_id", F.round(ratio(F.coalesce("text", F.lit("")).cast("binary")), 6).alias("ratio"), (ratio(F.coalesce("text", F.lit("")).cast("binary")) >= ewf.POOR).alias("stored"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return _Q[name](spark, sf_dir)
