"""Queries over the supplied tables for assets, listings, songs and re-scans, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanweave.operators import gates, intervals, timeline, vectors
from spanweave.plans import reports
from spanweave.plans.queries import ALIGNED, SPANS, TURNS, _aligned, query
from spanweave.sources import assets, files, scripts, tables
from spanweave.sources.tables import BIN_S, read

# ---- scripts ----


@query("""WITH c AS (SELECT conv_id AS script, turn * 2 AS row, role, length(text) AS n, turn % 3 AS k FROM conversations)
SELECT script, row::BIGINT AS row, CASE WHEN role = 'system' THEN 'character' END AS reject_reason, row::DOUBLE AS start_s, CASE k WHEN 0 THEN 'said, "' || n || '" and more' WHEN 1 THEN 'two lines, one cell' ELSE 'plain' END AS text FROM c""")
def csv_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV scripts whose quoted cells run over two lines, with separators and quotes inside."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script"), (F.col("turn") * 2).cast("long").alias("row"), F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("who"), F.length("text").alias("n"), (F.col("turn") % 3).alias("k"))
    head = F.concat_ws(",", "row", F.col("row") + 3, "who")
    first = F.when(F.col("k") == 0, F.concat(head, F.lit(',"said, ""'), "n", F.lit('""'))).when(F.col("k") == 1, F.concat(head, F.lit(',"two lines'))).otherwise(F.concat(head, F.lit(",plain")))
    second = F.when(F.col("k") == 0, ' and more"').when(F.col("k") == 1, ', one cell"')
    lines = t.select("script", F.explode(F.array(F.struct("row", first.alias("value")), F.struct((F.col("row") + 1).alias("row"), second.alias("value")))).alias("x")).select("script", "x.*").where("value is not null")
    return scripts.csv_segments(lines, {"start": 0, "end": 1, "character": 2, "text": 3}, ",").select("script", "row", "reject_reason", "start_s", "text")


# ---- deliveries ----

NAMED_FILES = """files AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'EP' || p_size || '_x.wav' WHEN 1 THEN 'Ann_PREMIX.WAV' WHEN 2 THEN 'script.final.DocX' WHEN 3 THEN '.wav' WHEN 4 THEN 'notes' WHEN 5 THEN 'low.mp4' WHEN 6 THEN 'M&E master.flac' WHEN 7 THEN 'lines.tsv' ELSE 'list.xlsx' END AS name,
  CASE p_partkey // 9 % 8 WHEN 0 THEN 'misc' WHEN 1 THEN 'Tamil Tracks' WHEN 2 THEN 'MAL' WHEN 3 THEN 'normal' WHEN 4 THEN 'EP 4 FOR AI' WHEN 5 THEN 'a mar b' WHEN 6 THEN 'mar_2' END AS folder FROM part)"""


@query(rf"""WITH {NAMED_FILES}, f AS (SELECT *, lower(name) AS n, lower(coalesce(folder, '')) AS d FROM files)
SELECT id, CASE WHEN n LIKE '%.docx' OR n LIKE '%.xlsx' THEN 'script' WHEN length(n) > 4 AND (n LIKE '%.wav' OR n LIKE '%.flac') THEN
  CASE WHEN contains(d, 'track') OR contains(d, 'for ai') OR regexp_matches(d, '\b(tamil|mal|mar)\b') THEN 'track' ELSE 'original' END ELSE 'other' END AS kind FROM f""")
def asset_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What delivered files are, by name and by the folder that they are in."""
    n, k, f = F.col("p_partkey"), F.col("p_partkey") % 9, F.floor(F.col("p_partkey") / 9) % 8
    name = F.when(k == 0, F.concat(F.lit("EP"), "p_size", F.lit("_x.wav")))
    for i, v in enumerate(("Ann_PREMIX.WAV", "script.final.DocX", ".wav", "notes", "low.mp4", "M&E master.flac", "lines.tsv"), 1):
        name = name.when(k == i, v)
    folder = F.when(f == 0, "misc")
    for i, v in enumerate(("Tamil Tracks", "MAL", "normal", "EP 4 FOR AI", "a mar b", "mar_2"), 1):
        folder = folder.when(f == i, v)
    return read(spark, sf_dir, "part").select(n.alias("id"), files.classify(name.otherwise("list.xlsx"), folder).alias("kind"))


ORIGINALS = """f AS (SELECT p_partkey AS id, p_type AS series, p_size AS episode, p_partkey // 7 % 4 AS folder, CASE p_partkey % 7 WHEN 0 THEN 'Show_#' || p_size || '_ST_MIX.wav' WHEN 1 THEN 'S1_E' || p_size || ' PreMix R' || p_partkey % 3 || '.wav' WHEN 2 THEN 'EP ' || p_size || ' low.mp4'
  WHEN 3 THEN 'Show_#' || p_size || '_HINDI ST MIX long.WAV' WHEN 4 THEN 'EPI-' || p_size || '.mov' WHEN 5 THEN 'EP_' || p_size || '_mix.wav' ELSE 'Step ' || p_size || '_stmix.wav' END AS name FROM part)"""


@query(rf"""WITH {ORIGINALS}, c AS (SELECT *, CASE folder WHEN 0 THEN 'mix' WHEN 3 THEN 'video' ELSE 'premix' END AS role, lower(name) AS n FROM f WHERE id % 7 <> 6),
e AS (SELECT *, regexp_replace(n, '[^a-z0-9]', '', 'g') AS q FROM c WHERE CASE role WHEN 'video' THEN n LIKE '%.mp4' OR n LIKE '%.mov' ELSE n LIKE '%.wav' END),
m AS (SELECT *, CASE role WHEN 'mix' THEN contains(q, 'stmix') AND NOT contains(q, 'premix') WHEN 'premix' THEN contains(q, 'premix') ELSE true END AS fits FROM e),
v AS (SELECT *, row_number() OVER (PARTITION BY series, episode, role ORDER BY name DESC, id) AS late FROM m)
SELECT series, episode, role, id, name, fits AND row_number() OVER (PARTITION BY series, episode ORDER BY NOT fits, CASE role WHEN 'mix' THEN 0 WHEN 'premix' THEN 1 ELSE 2 END, CASE WHEN role = 'premix' THEN folder END, CASE WHEN role = 'video' THEN late ELSE length(name) END, id) = 1 AS "default" FROM v""")
def original_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that could be an episode's original, and the one taken."""
    p, n, k = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 7
    size = F.col("p_size").cast("string")
    named = F.when(k == 0, F.concat(F.lit("Show_#"), size, F.lit("_ST_MIX.wav"))).when(k == 1, F.concat(F.lit("S1_E"), size, F.lit(" PreMix R"), n % 3, F.lit(".wav"))).when(k == 2, F.concat(F.lit("EP "), size, F.lit(" low.mp4"))).when(k == 3, F.concat(F.lit("Show_#"), size, F.lit("_HINDI ST MIX long.WAV")))
    named = named.when(k == 4, F.concat(F.lit("EPI-"), size, F.lit(".mov"))).when(k == 5, F.concat(F.lit("EP_"), size, F.lit("_mix.wav"))).otherwise(F.concat(F.lit("Step "), size, F.lit("_stmix.wav")))
    listed = p.select(F.concat_ws("/", "p_type", (F.floor(n / 7) % 4).cast("string")).alias("folder"), n.alias("id"), named.alias("name"))
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(o).alias("ord")) for r, o in (("mix", 0), ("premix", 1), ("premix", 2), ("video", 3))))).alias("x")
    roots = p.select(F.col("p_type").alias("series")).distinct().select("series", roles).select("series", "x.role", F.concat_ws("/", "series", F.col("x.ord").cast("string")).alias("folder"), "x.ord")
    return assets.originals(listed, roots, p.select(F.col("p_type").alias("series"), F.col("p_size").alias("episode")).distinct())


DUBS = """f AS (SELECT p_brand AS root, p_type AS lang, p_size AS episode, p_partkey AS id, p_retailprice AS size, CASE p_partkey % 6 WHEN 0 THEN p_type || '_ST_MIX_R' || p_partkey % 4 || '.wav' WHEN 1 THEN 'Economy PREMIX.wav' WHEN 2 THEN 'small Dialogue ' || p_partkey || '.wav' WHEN 3 THEN 'Ann.flac' WHEN 4 THEN 'promo_mix .wav' ELSE 'notes.txt' END AS name FROM part)"""


def _dubs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Folders and files of dubs, roots and requests: a brand's folder holds a folder an episode; brands of even number are a language's own, others shared."""
    p, n, k = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat("p_type", F.lit("_ST_MIX_R"), n % 4, F.lit(".wav"))).when(k == 1, "Economy PREMIX.wav").when(k == 2, F.concat(F.lit("small Dialogue "), n, F.lit(".wav"))).when(k == 3, "Ann.flac").when(k == 4, "promo_mix .wav").otherwise("notes.txt")
    sub = F.concat_ws("/", "p_brand", "p_size")
    folders = p.select(F.col("p_brand").alias("parent"), sub.alias("id"), F.concat(F.lit("MAL_EPI "), F.col("p_size").cast("string"), F.lit("_FOR AI")).alias("name")).distinct()
    listed = p.select(sub.alias("folder"), n.alias("id"), name.alias("name"), F.col("p_retailprice").alias("size"))
    number = F.substring("p_brand", 7, 9).cast("int")
    roots = p.select(F.lit("s").alias("series"), F.col("p_type").alias("lang"), F.col("p_brand").alias("folder"), number.alias("ord"), (number % 2 == 0).alias("own")).distinct()
    return folders, listed, roots, p.select(F.lit("s").alias("series"), F.col("p_type").alias("lang"), F.col("p_size").alias("episode")).distinct()


@query(rf"""WITH {DUBS}, r AS (SELECT DISTINCT p_type AS lang, p_brand AS root, substr(p_brand, 7)::INT AS ord FROM part), q AS (SELECT DISTINCT p_type AS lang, p_size AS episode FROM part),
c AS (SELECT q.lang, q.episode, r.ord, f.id, f.name, lower(f.name) AS n, regexp_replace(lower(f.name), '[^a-z0-9]', '', 'g') AS s FROM q JOIN r USING (lang) JOIN f ON f.root = r.root AND f.episode = q.episode WHERE f.name LIKE '%.wav' AND (r.ord % 2 = 0 OR contains(upper(f.name), upper(q.lang)))),
t AS (SELECT *, CASE WHEN contains(s, 'dialogue') THEN 0 WHEN contains(s, 'premix') THEN 1 WHEN contains(s, 'mix') THEN 2 END AS k FROM c)
SELECT 's' AS series, lang, episode, id, name, CASE k WHEN 0 THEN 'dialogue' WHEN 1 THEN 'premix' ELSE 'mix' END AS stage FROM t WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, episode ORDER BY ord, k, name DESC, id) = 1""")
def dub_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dubbed mix of each language and episode, at the preferred stage of the first folder that has one."""
    return assets.dub_mixes(*_dubs(spark, sf_dir), stages=("dialogue", "premix", "mix"))


@query(rf"""WITH {DUBS}, r AS (SELECT DISTINCT p_type AS lang, p_brand AS root, substr(p_brand, 7)::INT AS ord FROM part), q AS (SELECT DISTINCT p_type AS lang, p_size AS episode FROM part),
g AS (SELECT root, episode, count(*) AS tracks, max(size) AS longest FROM f WHERE name LIKE '%.wav' OR name LIKE '%.flac' GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT root, episode, tracks, count(*) FILTER (size < 0.75 * longest) AS short FROM f JOIN g USING (root, episode) WHERE name LIKE '%.wav' OR name LIKE '%.flac' GROUP BY ALL)
SELECT 's' AS series, lang, episode, root || '/' || episode AS id, 'MAL_EPI ' || episode || '_FOR AI' AS name, tracks, short, short = 0 AS uniform FROM q JOIN r USING (lang) JOIN s USING (root, episode) QUALIFY row_number() OVER (PARTITION BY lang, episode ORDER BY ord, root) = 1""")
def speaker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of speaker tracks of each language and episode, and whether they are alike in size."""
    return assets.speaker_sets(*_dubs(spark, sf_dir), least=2, share=0.75)


@query("""WITH d AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 'empty' WHEN 2 THEN 'no object' WHEN 3 THEN 'broken' END AS reason, length(text) AS n FROM conversations)
SELECT conv_id || '/' || turn AS path, reason, CASE WHEN reason IS NULL THEN n END::BIGINT AS missing, CASE WHEN reason IS NULL THEN 'L' || turn END AS lang FROM d""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results read with their skipped files: empty ones, ones that are no object, and broken ones."""
    k, n = F.col("turn") % 5, F.length("text")
    good = F.to_json(F.struct(F.concat(F.lit("L"), "turn").alias("lang"), n.alias("missing"), F.lit("x").alias("later")))
    content = F.when(k == 0, good).when(k == 1, " \n").when(k == 2, F.concat(F.lit("["), good, F.lit("]"))).when(k == 3, F.concat(F.lit('{"lang": "L", "missing": '), n, F.lit(", "))).otherwise(F.concat(F.lit(" \n"), good))
    stored = read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), content.alias("content"))
    rows, skipped = files.load_results(stored, T.StructType.fromDDL("lang string, missing long"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return rows.select("path", none("reason", "string"), "missing", "lang").union(skipped.select("path", "reason", none("missing", "long"), none("lang", "string")))


# ---- spans ----


@query(f"""WITH {SPANS}, a AS (SELECT key, id, start_s, end_s FROM spans WHERE kind <> 'click' UNION ALL SELECT key, -key, min(start_s), max(end_s) FROM spans GROUP BY key), b AS (SELECT key, id, start_s, CASE WHEN id % 2 = 0 THEN end_s ELSE start_s + 30 END AS end_s FROM spans WHERE kind = 'click')
SELECT a.key, a.id, count(*) AS met, sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS overlap_s FROM a JOIN b ON a.key = b.key AND b.start_s < a.end_s AND a.start_s < b.end_s GROUP BY a.key, a.id""")
def overlap_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of half a minute, of hours and of a user's whole time against each other, in bins of a minute."""
    s = tables.spans(spark, sf_dir).select("key", "id", "kind", "start_s", "end_s")
    hull = s.groupBy("key").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).select("key", (-F.col("key")).alias("id"), "start_s", "end_s")
    a = s.where("kind <> 'click'").drop("kind").union(hull)
    b = s.where("kind = 'click'").select("key", "id", "start_s", F.when(F.col("id") % 2 == 0, F.col("end_s")).otherwise(F.col("start_s") + 30).alias("end_s"))
    shared = intervals.overlap_seconds(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s"))
    return intervals.overlap_join(a, b, ["key"], 60.0, any_length=True).groupBy("key", "id").agg(F.count(F.lit(1)).alias("met"), F.sum(shared).alias("overlap_s"))


@query(f"""WITH {SPANS}, o AS (SELECT *, max(end_s) OVER (PARTITION BY kind ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT kind, start_s, start_s + value * 10 AS end_s FROM spans)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT kind, min(start_s) AS start_s, max(end_s) AS end_s FROM g GROUP BY kind, g""")
def hot_track_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the spans of five keys that hold all rows, by blocks of time."""
    s = tables.spans(spark, sf_dir).select("kind", "start_s", (F.col("start_s") + F.col("value") * 10).alias("end_s"))
    return intervals.coalesce_spans(s, ["kind"], block_s=BIN_S)


@query(f"""WITH {SPANS}, w AS (SELECT kind, id, start_s, start_s + 60 AS end_s, id % 50 = 0 AS ends, floor(start_s / 864000) AS win FROM spans), b AS (SELECT *, coalesce(start_s - lag(end_s) OVER o > 300 OR lag(ends) OVER o OR win <> lag(win) OVER o, true) AS b FROM w WINDOW o AS (PARTITION BY kind ORDER BY start_s, id)),
r AS (SELECT *, sum(b::INT) OVER (PARTITION BY kind ORDER BY start_s, id ROWS UNBOUNDED PRECEDING) AS line FROM b) SELECT kind, line::BIGINT AS line, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS words FROM r GROUP BY kind, line""")
def hot_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five keys that hold all rows, joined to lines by blocks of time."""
    words = tables.spans(spark, sf_dir).select("kind", F.col("id").alias("word"), "start_s", (F.col("start_s") + 60).alias("end_s"), (F.col("id") % 50 == 0).alias("ends"), F.floor(F.col("start_s") / 864_000).alias("window"))
    return timeline.words_to_lines(words, ["kind"], 300.0, block_s=BIN_S)


# ---- evidence ----


@query(f"""WITH {TURNS}, t AS (SELECT key, line, start_s AS at_s, CASE WHEN line % 4 = 0 THEN line // 8 END AS block, list_distinct(list_filter(string_split_regex(lower(text), '[^0-9a-zA-ZÀ-ɏऀ-ൿ]+'), lambda x: length(x) >= 2)) AS ws, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n, length(trim(text)) AS c FROM turns),
lyr AS (SELECT key, block AS id, line AS ll, at_s AS la, ws FROM t WHERE block IS NOT NULL AND len(ws) >= 3),
s AS (SELECT t.key, t.line, t.at_s, t.block, t.n, t.c, len(t.ws) AS own, id, ll, la, len(list_intersect(t.ws, lyr.ws)) AS shared FROM t JOIN lyr USING (key)),
again AS (SELECT key, line, arg_min(id, (la, ll)) AS block FROM s WHERE block IS NULL AND n >= 3 AND c >= 10 AND shared >= 3 AND shared >= 0.75 * own GROUP BY ALL),
a AS (SELECT DISTINCT key, line, at_s FROM s WHERE shared >= 2),
b AS (SELECT *, coalesce(at_s - lag(at_s) OVER (PARTITION BY key ORDER BY at_s) > 60, true) AS opens FROM a), r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY key ORDER BY at_s ROWS UNBOUNDED PRECEDING) AS run FROM b),
spans AS (SELECT key, min(at_s) - 15 AS lo, max(at_s) + 15 AS hi FROM r GROUP BY key, run HAVING count(*) >= 2)
SELECT key, line, 'block' AS source, block FROM again UNION ALL SELECT DISTINCT t.key, t.line, 'between', NULL FROM t JOIN spans ON spans.key = t.key AND at_s BETWEEN lo AND hi WHERE t.block IS NULL AND (t.key, t.line) NOT IN (SELECT (key, line) FROM again)""")
def song_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that sing again what a block sang, and those between such lines."""
    t = tables.turns(spark, sf_dir).select("key", "line", F.col("start_s").alias("at_s"), "text", F.when(F.col("line") % 4 == 0, F.floor(F.col("line") / 8)).alias("block"))
    return gates.song_tags(t, ["key"])


@query("""WITH m AS (SELECT label, d, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY ALL),
f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings), n AS (SELECT label, count(*) / 5.0 AS len FROM embeddings GROUP BY 1),
v AS (SELECT f.label, f.i, e.d, e.v::DOUBLE - m.m AS v FROM f JOIN (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS d FROM embeddings) e USING (vec_id) JOIN m ON m.label = f.label AND m.d = e.d),
q AS (SELECT f.label, vec_id AS flag, i, i / 5.0 + (vec_id % 7 - 3) * 0.9 AS at_s, 0.8 AS w, len FROM f JOIN n USING (label) WHERE vec_id % 20 = 0),
g AS (SELECT *, greatest(0, least(at_s - 2, len - w)) AS lo FROM q), h AS (SELECT *, greatest(lo, least(len - w, at_s + 2)) AS hi FROM g WHERE lo + w <= len + 1e-6),
ref AS (SELECT h.label, flag, d, avg(v) AS r FROM h JOIN v ON v.label = h.label AND v.i BETWEEN h.i AND h.i + 3 GROUP BY ALL), rn AS (SELECT flag, sqrt(sum(r * r)) AS norm FROM ref GROUP BY 1),
c AS (SELECT *, round(lo + k * 0.4, 2) AS a FROM h, (SELECT unnest(range(11)) AS k) WHERE k <= floor((hi - lo) / 0.4 + 1e-9) AND round(lo + k * 0.4, 2) + w <= len + 1e-6),
p AS (SELECT c.label, flag, a, d, avg(v) AS x FROM c JOIN v ON v.label = c.label AND v.i >= ceil(a * 5 - 1e-6) AND v.i < ceil((a + w) * 5 - 1e-6) GROUP BY ALL),
s AS (SELECT p.label, p.flag, a, round(sum(x * r) / sqrt(sum(x * x)) / any_value(norm), 9) AS sim FROM p JOIN ref ON ref.flag = p.flag AND ref.d = p.d JOIN rn ON rn.flag = p.flag GROUP BY ALL)
SELECT label, flag, a AS at_s, round(sim, 6) AS sim, sim >= 0.6 AS cleared FROM s QUALIFY row_number() OVER (PARTITION BY flag ORDER BY sim DESC, a) = 1""")
def sliding_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged windows of four vectors looked for near a place that is up to 2.7 s off."""
    e = read(spark, sf_dir, "embeddings").withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    frames = vectors.less_mean(e.select("label", "vec_id", "i", F.col("embedding").alias("vector")), ["label"])
    flags = frames.where("vec_id % 20 = 0").select("label", F.col("vec_id").alias("flag"), F.col("i").alias("first"), (F.col("i") / 5 + (F.col("vec_id") % 7 - 3) * 0.9).alias("at_s"))
    own = flags.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("first") + 3))).join(frames.select("label", "i", "vector"), ["label", "i"])
    places = own.select("label", "flag", F.posexplode("vector").alias("d", "v")).groupBy("label", "flag", "d").agg(F.avg("v").alias("v"))
    ref = places.groupBy("label", "flag").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("vector"))
    unit = F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)))
    flags = flags.join(ref.withColumn("vector", unit), ["label", "flag"]).select("label", "flag", "at_s", F.lit(0.8).alias("window_s"), "vector")
    found = vectors.rescan(flags, frames.select("label", "i", "vector"), "label", 5.0)
    return found.withColumn("sim", F.round("sim", 6))


@query(f"""WITH {ALIGNED} SELECT key::VARCHAR AS lang, type, speaker AS character, start_s, line FROM typed WHERE contains(lower(speaker), 'i') AND type = 'MISSING' ORDER BY lang, start_s, line LIMIT 25""")
def findings_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 missing lines of speakers whose name holds a text: a top-k report."""
    f = _aligned(spark, sf_dir)["findings"].select(F.col("key").cast("string").alias("lang"), "type", F.col("speaker").alias("character"), "start_s", "line")
    return reports.find(f, kind="missing", character="I")
