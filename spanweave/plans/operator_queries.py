"""Further queries over the supplied tables, registered beside those of ``queries``: names, inventories, levels, timelines and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.config import LEVEL, MAPPING
from spanweave.functions import levels, names, texts, timecode
from spanweave.operators import asof, segments, timeline, vectors
from spanweave.operators import names as fuzzy
from spanweave.operators.mapping import group_named
from spanweave.plans import reports
from spanweave.plans.queries import ALIGNED, FRAMES, SPANS, TIERED, TURNS, XLANG, _aligned, _languages, _tiered, query
from spanweave.sources import files, scripts, tables
from spanweave.sources.tables import BIN_S, read

# ---- scripts and names ----


@query(r"""WITH c AS (SELECT conv_id AS script, turn AS row, role, length(text) AS n, turn % 3 AS k FROM conversations)
SELECT script, row::BIGINT AS row, CASE k WHEN 1 THEN 'short' WHEN 2 THEN NULL ELSE CASE WHEN role = 'system' THEN 'character' END END AS reject_reason, CASE WHEN k <> 1 THEN row::DOUBLE END AS start_s, CASE WHEN k <> 1 THEN 'a, "' || n || '"' END AS text FROM c WHERE k <> 2
UNION ALL SELECT script, row, CASE WHEN role = 'system' THEN 'character' END, row::DOUBLE, '' FROM c WHERE k = 2""")
def csv_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV scripts: quoted cells, empty last cells, and rows without all columns, which count as dropped."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script"), F.col("turn").cast("long").alias("row"), "role", F.length("text").alias("n"), (F.col("turn") % 3).alias("k"))
    who = F.when(F.col("role") == "system", "").otherwise(F.col("role"))
    full = F.concat_ws(",", "row", F.col("row") + 2, who, F.concat(F.lit('"a, ""'), "n", F.lit('"""')))
    value = F.when(F.col("k") == 1, F.concat_ws(",", "row", F.col("row") + 2)).when(F.col("k") == 2, F.concat(F.concat_ws(",", "row", F.col("row") + 2, who), F.lit(","))).otherwise(full)
    out = scripts.csv_segments(t.select("script", "row", value.alias("value")), {"start": 0, "end": 1, "character": 2, "text": 3}, ",")
    short = F.col("reject_reason") == "short"
    return out.select("script", "row", "reject_reason", F.when(~F.coalesce(short, F.lit(False)), F.col("start_s")).alias("start_s"), F.when(~F.coalesce(short, F.lit(False)), F.col("text")).alias("text"))


@query(r"""WITH c AS (SELECT conv_id AS script, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row, turn % 4 AS k FROM conversations)
SELECT script, row::BIGINT AS row, turn::DOUBLE AS start_s, turn + 1.5 AS end_s, CASE k WHEN 0 THEN upper(role) WHEN 1 THEN role ELSE '' END AS character, CASE k WHEN 2 THEN 'no speaker here' ELSE 'said it' END AS text, CASE WHEN k = 3 THEN 'order' END AS reject_reason FROM c WHERE k <> 3
UNION ALL SELECT script, row, turn, turn, '', 'said it', 'order' FROM c WHERE k = 3""")
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with speakers before a colon, in brackets, or none; cues that end where they begin are dropped."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script"), "turn", "role", (F.col("turn") % 4).alias("k"))
    stamp = lambda s: F.format_string("00:00:%02d,%03d", F.floor(s), ((s - F.floor(s)) * 1000).cast("int"))
    said = F.when(F.col("k") == 0, F.concat(F.upper("role"), F.lit(": <i>said</i>\nit"))).when(F.col("k") == 1, F.concat(F.lit("["), "role", F.lit("] said it"))).when(F.col("k") == 2, F.lit("no speaker here")).otherwise(F.lit("said it"))
    block = F.concat_ws("\n", "turn", F.concat(stamp(F.col("turn") * F.lit(1.0)), F.lit(" --> "), stamp(F.col("turn") + F.when(F.col("k") == 3, 0.0).otherwise(1.5))), said)
    content = t.groupBy("script").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return scripts.cues(content).select("script", F.col("row").cast("long").alias("row"), "start_s", "end_s", "character", "text", "reject_reason")


@query("""WITH s AS (SELECT p_type AS key, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' [aside]' WHEN 1 THEN p_brand || '/' || p_container WHEN 2 THEN p_brand ELSE '(off)' END AS label, p_size::DOUBLE AS start_s, p_size + (p_partkey % 3)::DOUBLE - 0.5 AS end_s FROM (SELECT *, p_type AS p_container FROM part) p),
c AS (SELECT key, trim(regexp_replace(label, '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g')) AS name, ord FROM s), n AS (SELECT key, name, count(*) AS n, min(ord) AS first FROM c WHERE name <> '' AND NOT contains(name, '/') GROUP BY ALL),
d AS (SELECT key, name FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1)
SELECT s.key, list_sort(list(DISTINCT label)) AS aliases, count(*) AS line_count, round(sum(greatest(0, end_s - start_s)), 2) AS total_s, round(min(start_s), 3) AS first_s, coalesce(any_value(d.name), s.key) AS name FROM s LEFT JOIN d USING (key) GROUP BY s.key""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers with labels, some with tags or of two, and a display name."""
    n = F.col("p_partkey")
    label = F.when(n % 4 == 0, F.concat("p_brand", F.lit(" [aside]"))).when(n % 4 == 1, F.concat_ws("/", "p_brand", "p_type")).when(n % 4 == 2, F.col("p_brand")).otherwise("(off)")
    s = read(spark, sf_dir, "part").select(F.col("p_type").alias("key"), label.alias("label"), F.col("p_size").cast("double").alias("start_s"), (F.col("p_size") + (n % 3) - 0.5).alias("end_s"), n.alias("ord"))
    return reports.entities(s)


NAMED = """n AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'Show_#' || page_id % 50 || '_X' WHEN 1 THEN 'MAL EPI 0' || page_id % 60 || '_FOR AI' WHEN 2 THEN 'S1_E' || page_id % 70 WHEN 3 THEN 'Step ' || page_id WHEN 4 THEN 'EP ' || page_id % 9 || ' to ' || page_id % 9 + 5 WHEN 5 THEN 'guard 2' WHEN 6 THEN 'Random lady ' || page_id ELSE 'Ann_HI_ta' END AS name FROM pages)"""


@query(rf"""WITH {NAMED}, m AS (SELECT page_id, name, page_id % 8 AS k FROM n)
SELECT page_id, CASE k WHEN 0 THEN page_id % 50 WHEN 1 THEN page_id % 60 WHEN 2 THEN page_id % 70 WHEN 4 THEN page_id % 9 END::INT AS episode, CASE k WHEN 1 THEN page_id % 60 WHEN 3 THEN page_id WHEN 4 THEN page_id % 9 END::INT AS folder,
  CASE WHEN k = 4 THEN page_id % 9 END::INT AS first, CASE WHEN k = 4 THEN page_id % 9 + 5 END::INT AS last, CASE k WHEN 1 THEN 'Malayalam' WHEN 7 THEN NULL END AS language, k IN (4, 5) OR (k = 2 AND page_id % 70 < 10) AS generic, k IN (4, 5, 6) OR (k = 2 AND page_id % 70 < 10) AS voice_generic, CASE k WHEN 7 THEN 'ta' ELSE '?' END AS voice FROM m""")
def name_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes, ranges, languages and generic words that names of files, folders and voices carry."""
    n, k = F.col("page_id"), F.col("page_id") % 8
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    name = F.when(k == 0, text("Show_#", n % 50, "_X")).when(k == 1, text("MAL EPI 0", n % 60, "_FOR AI")).when(k == 2, text("S1_E", n % 70)).when(k == 3, text("Step ", n)).when(k == 4, text("EP ", n % 9, " to ", n % 9 + 5)).when(k == 5, "guard 2").when(k == 6, text("Random lady ", n)).otherwise("Ann_HI_ta")
    d = read(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    span, c = names.episode_range(F.col("name")), F.col("name")
    return d.select("page_id", names.episode_number(c).alias("episode"), names.folder_episode(c).alias("folder"), span["first"].alias("first"), span["last"].alias("last"), files.language_of(c).alias("language"), names.generic(c).alias("generic"), names.generic(c, names.ROLE_WORDS + names.VOICE_WORDS).alias("voice_generic"), names.voice_languages(c)[0].alias("voice"))


@query("""SELECT p_partkey, len(list_filter(list_distinct(string_split(lower(p_name), ' ')), x -> length(x) >= 3 AND list_contains(string_split(lower(p_type), ' '), x))) > 0 OR p_size % 2 = 0 AS shares FROM part""".replace("x -> ", "lambda x: "))
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two names have a word of three letters or more in common."""
    other = F.when(F.col("p_size") % 2 == 0, F.concat_ws("-", F.element_at(F.split("p_name", " "), 1), "p_type")).otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", names.shares_word(F.col("p_name"), other).alias("shares"))


@query("""WITH a(entry, alias) AS (VALUES ('A', 'red'), ('A', 'blue gear'), ('B', 'widget'), ('C', 'ring green')), n AS (SELECT DISTINCT p_name FROM part)
SELECT p_name, CASE WHEN count(DISTINCT entry) = 1 THEN min(entry) END AS entry, count(DISTINCT entry) AS hits FROM n JOIN a ON regexp_matches(lower(p_name), '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])') GROUP BY p_name""")
def alias_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names bound to the one entry whose alias, of one word or two, they hold."""
    aliases = spark.createDataFrame([("A", "red"), ("A", "blue gear"), ("B", "widget"), ("C", "ring green")], "entry string, alias string")
    return files.alias_hits(read(spark, sf_dir, "part").select("p_name").distinct(), aliases, "p_name")


@query("""WITH p AS (SELECT c_custkey, s_suppkey, ((c_custkey * 7 + s_suppkey * 13) % 101) / 100.0::DOUBLE AS name_score, CASE WHEN s_suppkey % 3 = 0 THEN ((c_custkey + s_suppkey) % 100) / 100.0::DOUBLE END AS channel_score, s_suppkey % 2 = 0 AS has_id, c_custkey % 4 = 0 AS generic FROM customer JOIN supplier ON s_nationkey = c_nationkey),
r AS (SELECT *, greatest(name_score, coalesce(channel_score, 0)) AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY greatest(name_score, coalesce(channel_score, 0)) DESC, has_id DESC, s_suppkey) AS r FROM p)
SELECT c_custkey, s_suppkey, round(score, 3) AS score FROM r WHERE r = 1 AND score >= CASE WHEN generic THEN 0.98 ELSE 0.8 END""")
def voice_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voice list's best entry for each character, by name or by channel, which are remainders of the keys."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    characters = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(c >= 0, c * 7 % 101).alias("name"), F.when(c >= 0, c % 100).alias("channel"), c.alias("number"), F.when(c < 0, c).alias("below"), (c % 4 == 0).alias("generic"))
    entries = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(s >= 0, s * 13 % 101).alias("voice"), F.when((s >= 0) & (s % 3 == 0), s % 100).alias("track"), s.alias("number"), F.when(s < 0, s).alias("below"), (s % 2 == 0).alias("has_id"), s.alias("ord"))
    # the remainder of a sum takes its sign, so a key below zero, which no table has, is scored as it is
    whole = lambda a, b: F.greatest((a * 7 + b * 13) % 101, F.when(b % 3 == 0, (a + b) % 100)) / 100
    scores = [("name", "voice", lambda a, b: (a + b) % 101 / 100), ("channel", "track", lambda a, b: (a + b) % 100 / 100), ("below", "number", whole), ("number", "below", whole)]
    return fuzzy.match_voices(characters, entries, ["c_custkey"], ["nation"], "s_suppkey", scores)


@query("""SELECT p_partkey, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(bg|walla|crowd|group|kids)($|[^a-z0-9])') OR contains(regexp_replace(t, '[^a-z0-9]', '', 'g'), 'walla') OR contains(regexp_replace(t, '[^a-z0-9]', '', 'g'), 'crowd') THEN true ELSE false END AS bundle, p_size <= 6 AND p_size * 7 <= 30 AS bit_part
FROM (SELECT p_partkey, p_size, lower(p_name || CASE p_partkey % 5 WHEN 0 THEN '_BG' WHEN 1 THEN ' myWallas2' WHEN 2 THEN '-kids-' WHEN 3 THEN 'kidsmob' ELSE '' END) AS t FROM part)""")
def bundles_and_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks named like bundles of small parts, and parts small enough to be in one."""
    n = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(n == 0, "_BG").when(n == 1, " myWallas2").when(n == 2, "-kids-").when(n == 3, "kidsmob").otherwise(""))
    bit = (F.col("p_size") <= MAPPING.bit_lines) & (F.col("p_size") * 7 <= MAPPING.bit_seconds)
    return read(spark, sf_dir, "part").select("p_partkey", group_named(name).alias("bundle"), bit.alias("bit_part"))


@query("""WITH q AS (SELECT conv_id, turn, turn % 10 / 15.0 AS nsp, -(turn % 7) / 4.0 AS alp, 1.5 + turn % 5 / 3.0 AS cr, CASE turn % 3 WHEN 0 THEN 'sarvam' WHEN 1 THEN 'scribe' ELSE 'x' END AS engine, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN nsp >= 0.5 OR cr > CASE engine WHEN 'sarvam' THEN 1.7 ELSE 2.4 END OR (engine = 'scribe' AND alp < -0.35) THEN false ELSE alp > -1.2 OR n >= 4 END AS reliable, round(greatest(0.2, least(0.8, 1 - turn % 10 / 15.0 * 0.5)), 9) AS least_coverage FROM q""")
def reliable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a transcript that can be trusted, and the coverage asked for at a tolerance."""
    n = F.col("turn")
    q = F.struct((n % 10 / 15).alias("nsp"), (-(n % 7) / 4).alias("alp"), (1.5 + n % 5 / 3).alias("cr"), F.when(n % 3 == 0, "sarvam").when(n % 3 == 1, "scribe").otherwise("x").alias("engine"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", texts.reliable(q, F.col("text")).alias("reliable"), F.round(levels.tolerated_coverage(n % 10 / 15), 9).alias("least_coverage"))


@query("""SELECT event_id, ((event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59) * 48000 + (event_id % 25) * 1920 AS position, 'Show-X_EP' || printf('%02d', event_id % 120) || '_Report_2024-01-' || printf('%02d', 1 + event_id % 28) AS file,
  CASE event_id % 6 WHEN 0 THEN 'help' WHEN 1 THEN 'status' WHEN 2 THEN 'audio_run' WHEN 3 THEN 'run' WHEN 4 THEN 'check' END AS command FROM events""")
def positions_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample positions of time codes, names of output files, and what messages ask for."""
    n = F.col("event_id")
    tc = F.format_string("%02d:%02d:%02d:%02d", n % 24, n % 60, n % 59, n % 25)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int"))
    said = F.when(n % 6 == 0, "Help").when(n % 6 == 1, "is it ready").when(n % 6 == 2, "start scriptless").when(n % 6 == 3, "go ahead").when(n % 6 == 4, F.concat(F.lit("episode "), n % 100)).otherwise("hello")
    return read(spark, sf_dir, "events").select("event_id", timecode.samples(tc).alias("position"), names.output_name(F.lit("show X"), (n % 120).cast("string"), "Report", day).alias("file"), names.command(said).alias("command"))


# ---- inventories ----


@query("""SELECT o_custkey AS lang, arg_max(o_orderkey, o_orderkey) AS run FROM orders GROUP BY 1""")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of each language that came last."""
    return files.latest_results(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lang"), F.col("o_orderkey").alias("run")), ["lang"], "run")


@query("""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'hi,ta' WHEN 1 THEN 'ta' ELSE '?' END AS l, 'abcdefghij01234567' || printf('%04d', s_suppkey % 10000) AS id FROM supplier)
SELECT s_suppkey, unnest(string_split(l, ',')) AS language, CASE s_suppkey % 3 WHEN 0 THEN 'V Hindi/Tamil' WHEN 1 THEN 'V_HI_ta' ELSE 'Vee' END AS name, id FROM c""")
def voice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices of a list's cells by language."""
    n = F.col("s_suppkey")
    cell = F.concat(F.when(n % 3 == 0, "V Hindi/Tamil").when(n % 3 == 1, "V_HI_ta").otherwise("Vee"), F.lit("\n"), F.lit("abcdefghij01234567"), F.lpad((n % 10000).cast("string"), 4, "0"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(files.voice_entries(cell)).alias("v")).select("s_suppkey", "v.language", "v.name", "v.id")


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, true AS folder FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || (n_nationkey % 5), n_name, true FROM nation WHERE n_nationkey % 5 <> 0 OR n_nationkey = 0
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name || CASE WHEN s_nationkey % 2 = 0 THEN '.wav' ELSE '.txt' END, false FROM supplier),
i AS (SELECT parent AS id, bool_or(NOT folder AND name LIKE '%.wav') AS audio, count(*) FILTER (folder) AS k, max(CASE WHEN folder THEN id END) AS child FROM n GROUP BY parent),
s1 AS (SELECT r.id AS start, CASE WHEN NOT audio AND k = 1 THEN child ELSE r.id END AS id FROM (SELECT id FROM n WHERE parent IS NULL) r LEFT JOIN i USING (id)),
s2 AS (SELECT start, CASE WHEN NOT audio AND k = 1 THEN child ELSE s1.id END AS id FROM s1 LEFT JOIN i USING (id)), s3 AS (SELECT start, CASE WHEN NOT audio AND k = 1 THEN child ELSE s2.id END AS id FROM s2 LEFT JOIN i USING (id)) SELECT * FROM s3""")
def wrapper_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder with the tracks below folders that hold one folder only."""
    nation = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0 or n_nationkey = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_nationkey") % 5).alias("parent"), F.col("n_name").alias("name"), F.lit(True).alias("folder"))
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(True).alias("folder"))
    leaf = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat("s_name", F.when(F.col("s_nationkey") % 2 == 0, ".wav").otherwise(".txt")).alias("name"), F.lit(False).alias("folder"))
    return files.descend(roots.union(nation).union(leaf), roots.select("id"))


@query("""WITH r AS (SELECT c_mktsegment AS entry, min(c_custkey) AS ord, list(DISTINCT 'F' || c_nationkey) FILTER (c_custkey % 7 = 0) AS folders FROM customer GROUP BY 1), e AS (SELECT entry, ord, unnest(folders) AS folder FROM r)
SELECT 'F' || n_nationkey AS folder, (SELECT entry FROM e WHERE folder = 'F' || n_nationkey ORDER BY ord LIMIT 1) AS entry FROM nation""")
def folder_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first registered series whose folders hold a folder."""
    registry = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("entry")).agg(F.min("c_custkey").alias("ord"), F.collect_set(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("F"), "c_nationkey"))).alias("folders"))
    return files.owner_of(read(spark, sf_dir, "nation").select(F.concat(F.lit("F"), "n_nationkey").alias("folder")), registry)


@query("""WITH f AS (SELECT p_brand AS key, p_partkey, CASE p_size % 4 WHEN 0 THEN 'A_PRE MIX_R' || p_size WHEN 1 THEN 'A_Tam_MIX_R' || p_size WHEN 2 THEN 'A_other' ELSE 'A_ST_MIX' END AS name FROM part),
g AS (SELECT key, name, CASE WHEN p.plain LIKE '%premix%' THEN 1 WHEN p.plain LIKE '%mix%' THEN 0 END AS stage FROM f, LATERAL (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS plain) p)
SELECT DISTINCT key, name, CASE stage WHEN 0 THEN 'stmix' ELSE 'premix' END AS stage FROM (SELECT * FROM g WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, name DESC) = 1)""")
def newest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last revision at the first stage that was delivered."""
    size = F.col("p_size")
    name = F.when(size % 4 == 0, F.concat(F.lit("A_PRE MIX_R"), size)).when(size % 4 == 1, F.concat(F.lit("A_Tam_MIX_R"), size)).when(size % 4 == 2, "A_other").otherwise("A_ST_MIX")
    f = read(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), name.alias("name"))
    return files.newest_revision(f, ["key"], ("stmix", "premix")).select("key", "name", "stage")


@query("""SELECT event_id // 100 AS run, 'SHOW' AS series, 'EP' || (event_id // 100) % 20 AS episode, event_id AS start, round(value, 2) AS slot_cov, '' || event_id AS text, event_id % 10 = 0 AS fragment, CASE WHEN event_id % 4 = 0 THEN 3 END AS block_n FROM events WHERE event_type = 'view'""")
def flat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing lines of stored reports, one row each."""
    n = F.col("event_id")
    error = F.struct(F.when(F.col("event_type") == "view", "MISSING").otherwise("EXTRA").alias("type"), n.cast("double").alias("script_start_s"), F.round("value", 2).alias("slot_speech_cov"), n.cast("string").alias("text"), F.when(n % 10 == 0, True).alias("fragment"), F.when(n % 4 == 0, F.struct(F.lit(3).alias("n"))).alias("block"))
    run = F.floor(n / 100)
    stored = read(spark, sf_dir, "events").groupBy(run.alias("run")).agg(F.to_json(F.struct(F.collect_list(error).alias("errors"))).alias("report")).withColumn("workbook", F.concat(F.lit("SHOW_Ep"), F.col("run") % 20, F.lit("_AudioQC.xlsx")))
    return files.flatten_reports(stored).select("run", "series", "episode", F.col("start").cast("long").alias("start"), "slot_cov", "text", "fragment", "block_n")


# ---- levels, timelines, vectors ----

HOURLY = f"""{SPANS}, frames AS (SELECT key, id, start_s, start_s + 1 AS end_s, (1 + floor(value)) / 500 AS rms, (1 + id % 7) / 10.0::DOUBLE AS music FROM spans)"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second of frame at the start of every event."""
    return tables.spans(spark, sf_dir).select("key", "id", "start_s", (F.col("start_s") + 1).alias("end_s"), ((1 + F.floor("value")) / 500).alias("rms"), ((1 + F.col("id") % 7) / 10).alias("music"))


@query(f"""WITH {HOURLY}, w AS (SELECT key, start_s, end_s, row_number() OVER (PARTITION BY key ORDER BY start_s, end_s) AS r FROM regions), i AS (SELECT w.key, f.rms FROM w JOIN frames f ON f.key = w.key AND f.start_s >= w.start_s AND f.end_s <= w.end_s WHERE r <= 10)
SELECT key, round(20 * log10(greatest(median(rms), 1e-9)), 1) AS reference_db FROM i GROUP BY key""")
def reference_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual level of the frames inside each key's first ten spans of activity."""
    return segments.reference_level(_hourly(spark, sf_dir), tables.regions(spark, sf_dir).select("key", "start_s", "end_s"), ["key"], BIN_S, 10)


@query(f"""WITH {HOURLY}, a AS (SELECT key, line, greatest(0, (start_s + greatest(end_s, start_s + 0.3)) / 2 - 7200) AS a, (start_s + greatest(end_s, start_s + 0.3)) / 2 + 7200 AS b FROM lines),
d AS (SELECT a.key, line, 20 * log10(greatest(sqrt(avg(music * music)), 1e-9)) - 20 * log10(greatest(sqrt(avg(rms * rms)), 1e-9)) AS d FROM a JOIN frames f ON f.key = a.key AND f.start_s >= a.a AND f.end_s <= a.b GROUP BY ALL HAVING sum(f.end_s - f.start_s) >= 3)
SELECT l.key, l.line, d >= 6 AS sung, round(d, 1) AS sung_margin_db FROM lines l LEFT JOIN d USING (key, line)""")
def sung_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around which the accompaniment is well above the voice."""
    frames = _hourly(spark, sf_dir).withColumnRenamed("rms", "voice")
    return segments.sung(tables.lines(spark, sf_dir), frames, ["key"], ["line"], BIN_S, 7_200.0, 6.0, 3.0).select("key", "line", "sung", "sung_margin_db")


@query(f"""WITH {HOURLY}, p AS (SELECT l.key, l.line, greatest(l.start_s - 3600, r.start_s) AS a, least(l.end_s + 3600, r.end_s) AS b FROM lines l JOIN regions r ON r.key = l.key AND r.start_s < l.end_s + 3600 AND l.start_s - 3600 < r.end_s),
h AS (SELECT DISTINCT p.key, p.line, f.start_s, f.rms FROM p JOIN frames f ON f.key = p.key AND f.start_s < p.b AND p.a < f.end_s)
SELECT key, line, round(20 * log10(greatest(sqrt(avg(rms * rms)), 1e-9)), 1) AS level_db, round(20 * log10(greatest(max(rms), 1e-9)), 1) AS peak_db FROM h GROUP BY ALL""")
def levels_in_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of lines from the frames of activity in their padded windows."""
    frames = _hourly(spark, sf_dir).withColumn("peak", F.col("rms"))
    return segments.levels_in_speech(tables.lines(spark, sf_dir), tables.regions(spark, sf_dir), frames, ["key"], ["line"], BIN_S, replace(LEVEL, pad_s=3_600.0))


@query(f"""WITH {SPANS}, p AS (SELECT l.key, l.id AS line, r.start_s AS at_s, 1 - abs(l.value - r.value) / 100 AS sim FROM spans l JOIN spans r ON r.key = l.key AND r.kind <> 'purchase' AND r.start_s >= l.start_s + 1800 - 7200 AND r.start_s <= l.end_s + 1800 + 7200 WHERE l.kind = 'purchase')
SELECT key, line, sim AS score, at_s FROM p WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY key, line ORDER BY sim DESC, at_s) = 1""")
def best_local_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar activity near each line's expected place."""
    s = tables.spans(spark, sf_dir)
    sim = 1 - F.abs(F.col("value") - F.col("r_value")) / 100
    return asof.best_in_window(s.where("kind = 'purchase'").withColumnRenamed("id", "line"), s.where("kind <> 'purchase'").select("key", "start_s", "value"), ["key"], ["line"], sim, 7_200.0, 1_800.0, BIN_S)


@query(f"""WITH {SPANS}, w AS (SELECT key, start_s AS c, round(value) / 10 AS d FROM spans WHERE kind = 'signup'), p AS (SELECT l.key, l.line, w.d, row_number() OVER (PARTITION BY l.key, l.line ORDER BY abs(c - start_s), c, d) AS r FROM lines l JOIN w ON w.key = l.key AND abs(c - l.start_s) <= 21600)
SELECT l.key, l.line, coalesce(p.d, -1.5) AS drift_s, greatest(-3, least(3, coalesce(p.d, -1.5))) AS clamped_s FROM lines l LEFT JOIN p ON p.key = l.key AND p.line = l.line AND r = 1""")
def drift_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift of the nearest confident window, and its clamped value."""
    w = tables.spans(spark, sf_dir).where("kind = 'signup'").select("key", F.col("start_s").alias("center_s"), (F.round("value") / 10).alias("drift_s"))
    points = tables.lines(spark, sf_dir).select("key", "line", F.col("start_s").alias("at_s"))
    return timeline.drift_at(points, w, ["key"], ["line"], -1.5, 21_600.0).select("key", "line", "drift_s", levels.clamp(F.col("drift_s"), 3.0).alias("clamped_s"))


@query("""WITH e AS (SELECT user_id, event_id, floor(value) AS pct, max(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, event_id, pct::BIGINT AS pct FROM e WHERE before IS NULL OR pct > before""")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress that goes beyond all that was reported before."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor("value").alias("pct"))
    return timeline.monotone(e, ["user_id"], ["ts", "event_id"], "pct").select("user_id", "event_id", "pct")


@query(f"""WITH RECURSIVE {SPANS}, p AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_s) AS r, greatest(0, start_s - 2) AS from_s, end_s + 2 AS to_s FROM (SELECT key, start_s, max(end_s) AS end_s FROM spans WHERE kind = 'click' GROUP BY ALL)),
q AS (SELECT key, r, to_s - from_s AS n, coalesce(sum(to_s - from_s + 5) OVER (PARTITION BY key ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_s FROM p),
c AS (SELECT key, r, at_s AS begin, 0 AS chunk FROM q WHERE r = 1 UNION ALL SELECT q.key, q.r, CASE WHEN q.at_s + q.n - c.begin > 200000 THEN q.at_s ELSE c.begin END, CASE WHEN q.at_s + q.n - c.begin > 200000 THEN chunk + 1 ELSE chunk END FROM c JOIN q ON q.key = c.key AND q.r = c.r + 1)
SELECT c.key, q.at_s, chunk FROM c JOIN q ON q.key = c.key AND q.r = c.r""")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined windows in chunks of bounded length."""
    w = tables.spans(spark, sf_dir).where("kind = 'click'").groupBy("key", "start_s").agg(F.max("end_s").alias("end_s"))
    return timeline.chunked(timeline.concatenated(w, ["key"], 2.0, 5.0), ["key"], 200_000.0).select("key", "at_s", "chunk")


@query(f"""WITH {FRAMES}, s AS (SELECT user_id, i::DOUBLE AS a, floor(value) AS v, lead(i::DOUBLE) OVER w AS b, lead(floor(value)) OVER w AS u FROM frames WHERE i % 3 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY i)),
k AS (SELECT *, unnest(range(ceil(a / 2)::BIGINT, CASE WHEN b IS NULL THEN floor(a / 2)::BIGINT + 1 ELSE ceil(b / 2)::BIGINT END)) AS k FROM s) SELECT user_id, k * 2.0::DOUBLE AS at_s, round(v + CASE WHEN b IS NULL THEN 0 ELSE (k * 2 - a) / (b - a) * (u - v) END, 6) AS value FROM k""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third value, linearly interpolated at even places."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), F.floor("value").cast("double").alias("value")).where("i % 3 = 0")
    return timeline.resampled(s.select("user_id", F.col("i").cast("double").alias("at_s"), "value"), ["user_id"], 2.0).withColumn("value", F.round("value", 6))


@query("""WITH p AS (SELECT vec_id, label, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM p GROUP BY ALL), c AS (SELECT vec_id, k, v - m AS c FROM p JOIN m USING (label, k)), n AS (SELECT vec_id, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
SELECT vec_id, round(sum(CASE WHEN k = 1 THEN c END) / greatest(any_value(n), 1e-12), 4) AS first, round(sum(c / greatest(n, 1e-12)), 4) AS total FROM c JOIN n USING (vec_id) GROUP BY vec_id""")
def centred_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings less their label's mean, of length 1."""
    out = vectors.centred(read(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.select("vec_id", F.round(F.col("embedding")[0], 4).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH {SPANS}, w AS (SELECT key, start_s, greatest(0, start_s - 2) AS a, max(end_s) + 2 AS b FROM spans WHERE kind = 'click' GROUP BY ALL), p AS (SELECT *, coalesce(sum(b - a + 5) OVER (PARTITION BY key ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM w),
q AS (SELECT user_id AS key, event_id AS id, (event_id * 997) % 100000 AS t FROM events) SELECT q.key, q.id, a + least(t - o, b - a) AS original_s FROM q JOIN p ON p.key = q.key AND t >= o AND t < o + b - a + 5""")
def map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of joined windows in original time."""
    w = tables.spans(spark, sf_dir).where("kind = 'click'").groupBy("key", "start_s").agg(F.max("end_s").alias("end_s"))
    points = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.col("event_id") * 997 % 100_000).cast("double").alias("at"))
    return timeline.map_back(points, timeline.concatenated(w, ["key"], 2.0, 5.0), ["key"], 5.0, BIN_S).select("key", "id", "original_s")


# ---- reports ----


@query(f"""WITH {ALIGNED} SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY CASE type WHEN 'MISSING' THEN 0 WHEN 'MISMATCH' THEN 1 WHEN 'MISALIGNED' THEN 2 ELSE 4 END, start_s, line) AS position FROM typed""")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a sheet lists them: by type, then by time."""
    f = _aligned(spark, sf_dir)["findings"].withColumn("script_start_s", F.col("start_s"))
    return reports.finding_order(f, ["key"]).select("key", "line", F.col("position").cast("long").alias("position"))


@query(f"""WITH {ALIGNED}, s AS (SELECT speaker AS lang, key, count(*) FILTER (type = 'OK') % 3 AS no_audio, count(*) FILTER (type = 'MISSING') AS missing, count(*) FILTER (type = 'MISMATCH') AS mismatch FROM typed GROUP BY ALL)
SELECT key, lang, row_number() OVER (PARTITION BY key ORDER BY no_audio DESC, missing DESC, mismatch DESC, lang) AS position FROM s""")
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by how much is wrong with them."""
    n = lambda t: F.count_if(F.col("type") == t)
    s = _aligned(spark, sf_dir)["findings"].groupBy("key", F.col("speaker").alias("lang")).agg((n("OK") % 3).alias("no_audio"), n("MISSING").alias("missing"), n("MISMATCH").alias("mismatch"))
    return reports.worst_first(s, ["key"]).select("key", "lang", F.col("position").cast("long").alias("position"))


CAST_LIST = """who AS (SELECT c_nationkey AS key, 'C' || c_custkey AS character, c_custkey % 5 AS lines, CASE WHEN c_custkey % 3 = 0 THEN 'T' || c_custkey % 20 END AS channel, CASE WHEN c_custkey % 7 = 0 THEN 'walla' END AS grouped_in FROM customer),
tracks AS (SELECT DISTINCT c_nationkey AS key, 'T' || c_custkey % 25 AS channel FROM customer)"""


def _cast_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, n = read(spark, sf_dir, "customer"), F.col("c_custkey")
    who = c.select(F.col("c_nationkey").alias("key"), F.concat(F.lit("C"), n).alias("character"), (n % 5).alias("lines"), F.when(n % 3 == 0, F.concat(F.lit("T"), n % 20)).alias("channel"), F.when(n % 7 == 0, "walla").alias("grouped_in"))
    return who, c.select(F.col("c_nationkey").alias("key"), F.concat(F.lit("T"), n % 25).alias("channel")).distinct()


@query(f"""WITH {CAST_LIST}, f AS (SELECT c_nationkey AS key, o_orderpriority AS type FROM (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'MISALIGNED' WHEN 3 THEN 'EXTRA' ELSE 'OK' END AS o_orderpriority FROM orders) JOIN customer ON c_custkey = o_custkey),
n AS (SELECT key, count(*) FILTER (type = 'MISSING') AS missing, count(*) FILTER (type = 'MISMATCH') AS wrong_speaker, count(*) FILTER (type = 'MISALIGNED') AS misaligned, count(*) FILTER (type = 'EXTRA') AS extra FROM f GROUP BY key),
w AS (SELECT key, count(*) AS characters, coalesce(list_sort(list(character) FILTER (channel IS NULL AND grouped_in IS NULL AND lines > 0)), []) AS no_audio FROM who GROUP BY key)
SELECT w.*, (SELECT count(*) FROM tracks t WHERE t.key = w.key) AS tracks, coalesce(missing, 0) AS missing, coalesce(wrong_speaker, 0) AS wrong_speaker, coalesce(misaligned, 0) AS misaligned, coalesce(extra, 0) AS extra FROM w LEFT JOIN n USING (key)""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per language and what qualifies them."""
    who, tracks = _cast_list(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("MISSING", "MISMATCH", "MISALIGNED", "EXTRA", "OK"))), (F.col("o_orderkey") % 5).cast("int") + 1)
    f = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), kind.alias("type")).join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key")), "c_custkey")
    return reports.overview(f.select("key", "type"), who, tracks, ["key"])


@query(f"""WITH {CAST_LIST}, t AS (SELECT t.key, t.channel, EXISTS (SELECT 1 FROM who w WHERE w.key = t.key AND w.channel = t.channel) AS owned FROM tracks t),
a AS (SELECT key, count(*) AS tracks, count(*) FILTER (NOT owned) AS unclaimed, coalesce(list_sort(list(channel) FILTER (NOT owned))[1:4], []) AS unclaimed_first FROM t GROUP BY key),
b AS (SELECT key, count(*) FILTER (channel IS NULL AND grouped_in IS NULL AND lines > 0) AS no_track, count(DISTINCT channel) AS mapped FROM who GROUP BY key),
i AS (SELECT s_nationkey AS key, count(*) FILTER (s_suppkey % 4 = 0) AS twins, count(*) FILTER (s_suppkey % 4 = 1) AS swaps, count(*) FILTER (s_suppkey % 4 = 2) AS reassigned, count(*) FILTER (s_suppkey % 4 = 3) AS ambiguous FROM supplier GROUP BY 1)
SELECT a.*, no_track, mapped, coalesce(twins, 0) AS twins, coalesce(swaps, 0) AS swaps, coalesce(reassigned, 0) AS reassigned, coalesce(ambiguous, 0) AS ambiguous FROM a LEFT JOIN b USING (key) LEFT JOIN i USING (key)""")
def delivery_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete and how well packed each delivery is."""
    who, tracks = _cast_list(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("twin_merged", "swap_repaired", "reassigned", "ambiguous_name"))), (F.col("s_suppkey") % 4).cast("int") + 1)
    return reports.delivery_health(who, tracks, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), kind.alias("kind")), ["key"])


@query(f"""WITH {XLANG}, f AS (SELECT n_name AS lang, l_orderkey * 10 + l_linenumber AS line, l_orderkey AS start_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R'),
e AS (SELECT lang, list(line ORDER BY start_s, line)[1:6] AS examples FROM f GROUP BY lang)
SELECT s.lang, sum(missing)::BIGINT AS missing, count(*) FILTER (missing = lines) AS no_audio, coalesce(list_sort(list(character) FILTER (missing = lines))[1:4], []) AS undelivered, list(character ORDER BY missing DESC, character)[1:4] AS top_missing, any_value(examples) AS examples, greatest(count(*) FILTER (missing = lines) - 4, 0) AS undelivered_more FROM stats s LEFT JOIN e ON e.lang = s.lang GROUP BY s.lang""")
def language_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the characters that miss most and the first missing lines."""
    t = lambda n: read(spark, sf_dir, n)
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("lang"))
    owner = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nation, "c_nationkey").select("l_orderkey", "lang")
    missing = t("lineitem").where("l_returnflag = 'R'").join(owner, "l_orderkey").select("lang", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_orderkey").alias("start_s"))
    return reports.digest(reports.language_stats(*_languages(spark, sf_dir)), missing)


@query(f"""WITH {SPANS}, p AS (SELECT l.key, l.line, l.start_s, r.start_s AS o, 1 / (1 + abs(r.start_s - l.start_s - 3600) / 3600) AS sim FROM lines l JOIN regions r ON r.key = l.key AND abs(r.start_s - l.start_s) <= 14400),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key, line ORDER BY sim DESC, o) = 1) SELECT key, line, round(o - start_s, 2) AS drift_s, CASE WHEN o > start_s THEN 'late' ELSE 'early' END AS direction, round(sim, 3) AS coverage FROM b WHERE abs(o - start_s) > 1800""")
def retimed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose best match lies well away from where it should."""
    near = asof_pairs(spark, sf_dir)
    sim = 1 / (1 + F.abs(F.col("other_start_s") - F.col("start_s") - 3600) / 3600)
    return reports.retimed(near.withColumn("sim", sim), ["key"], 1_800.0)


def asof_pairs(spark: SparkSession, sf_dir: str, within: float = 14_400.0) -> DataFrame:
    """Lines and the starts of activity near them, joined over time bins."""
    lines = tables.lines(spark, sf_dir).select("key", "line", "start_s").withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("start_s") / within) + d)))
    regions = tables.regions(spark, sf_dir).select("key", F.col("start_s").alias("other_start_s")).withColumn("bin", F.floor(F.col("other_start_s") / within))
    return lines.join(regions, ["key", "bin"]).where(F.abs(F.col("other_start_s") - F.col("start_s")) <= within)


@query(f"""WITH {TURNS}, t AS (SELECT key, line, text, line % 4 <> 0 AS ok, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM turns) SELECT key, line FROM t WHERE ok AND NOT (len(w) >= 6 AND len(list_distinct(w)) < 0.5 * len(w)) AND len(w) >= 2""")
def extra_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra lines read well enough to count."""
    t = tables.turns(spark, sf_dir).withColumn("reliable", F.col("line") % 4 != 0)
    return reports.admitted_extras(t).select("key", "line")


@query(f"""WITH {TIERED}, d AS (SELECT tier, fill, greatest(0, end_s - start_s) AS s FROM tiers), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY s) AS k, count(*) OVER (PARTITION BY tier) AS n FROM d)
SELECT tier, count(*) AS n, avg((coalesce(fill, '') = 'silence')::INT) AS silence_share, max(CASE WHEN k = n // 2 + 1 THEN s END) AS median_s, count(*) / (SELECT count(*) FROM d) AS share FROM r GROUP BY tier""")
def tier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tiers follow evidence that they were not fitted to."""
    return reports.tier_evaluation(_tiered(spark, sf_dir).select("tier", "fill", F.col("start_s").alias("start"), F.col("end_s").alias("end")))


@query(f"""WITH {TIERED}, e AS (SELECT key, count(*) FILTER (tier = 'high') AS high FROM tiers GROUP BY key), r AS (SELECT high, row_number() OVER (ORDER BY high) AS k, count(*) OVER () AS n FROM e) SELECT min(high) AS least, max(CASE WHEN k = n // 2 + 1 THEN high END) AS median, max(high) AS most FROM r""")
def high_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of the highest tier an episode has."""
    return reports.high_load(_tiered(spark, sf_dir).select(F.col("key").alias("episode"), "tier"))


@query("""SELECT event_id, printf('%d:%02d.%d', floor(value * 10 + 0.5)::BIGINT // 600, (floor(value * 10 + 0.5)::BIGINT // 10) % 60, floor(value * 10 + 0.5)::BIGINT % 10) AS at FROM events""".replace(" AS at", ' AS "at"'))
def minute_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as minutes and tenths."""
    return read(spark, sf_dir, "events").select("event_id", timecode.minutes(F.col("value")).alias("at"))
