"""Queries of the core: (spark, directory of the tables) -> DataFrame, and their DuckDB statements.

Every query runs over whole tables. Ratios are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions import content, paths, scalars, tokens
from .operators import check, clusters, graph, history, metrics, pairs
from .operators.changes import snapshot_changes, transitions
from .operators.fingerprints import text_fingerprints
from .scratch import small
from .sources.tables import compared_path, file_rows, placed_units, table, unit_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


_PATH = "regexp_replace(replace({}, '\\', '/'), '^(\\./)+', '')"
_FILES = f"files1 AS (SELECT file_id, arg_max({_PATH.format('path')}, loaded_at) AS file FROM files WHERE file_id IS NOT NULL GROUP BY file_id)"
_UNITS = """units1 AS (
  SELECT unit_id, any_value(lower(trim(lang))) AS lang, any_value(file_id) AS file_id, any_value(name) AS name, any_value(sig_lines) AS sig_lines, any_value(batch_no) AS batch_no,
         any_value(start_line) AS start_line, any_value(end_line) AS end_line, any_value(start_byte) AS start_byte, any_value(end_byte) AS end_byte,
         any_value(is_test) AS is_test, any_value(is_trait_impl_method) AS is_trait_impl_method,
         any_value(list_sort(list_distinct(list_filter(coalesce(fingerprints, []), lambda x: x IS NOT NULL)))) AS fps
  FROM units WHERE unit_id IS NOT NULL GROUP BY unit_id)"""
_CULL = f"""{_UNITS}, caps AS (SELECT lang, greatest({K.CULL_FLOOR}, count(*) // {K.CULL_SHARE}) AS cap FROM units1 WHERE lang IS NOT NULL GROUP BY lang),
fp0 AS (SELECT unit_id, lang, unnest(fps) AS fp FROM units1 WHERE lang IS NOT NULL),
freq AS (SELECT lang, fp, count(*) AS df FROM fp0 GROUP BY lang, fp),
hot AS (SELECT lang, fp, df FROM freq JOIN caps USING (lang) WHERE df > cap),
fp1 AS (SELECT * FROM fp0 ANTI JOIN hot USING (lang, fp)),
sets AS (SELECT unit_id, any_value(lang) AS lang, list_sort(list(fp)) AS cfps FROM fp1 GROUP BY unit_id),
classes AS (SELECT unit_id, min(unit_id) OVER (PARTITION BY lang, cfps) AS rep, len(cfps) AS n FROM sets),
fp2 AS (SELECT * FROM fp1 WHERE unit_id IN (SELECT rep FROM classes)),
shared AS (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS shared FROM fp2 x JOIN fp2 y ON x.lang = y.lang AND x.fp = y.fp AND x.unit_id < y.unit_id GROUP BY 1, 2),
cand AS (SELECT a, b, shared, na.n AS na, nb.n AS nb FROM shared JOIN classes na ON na.unit_id = a JOIN classes nb ON nb.unit_id = b WHERE shared >= {K.MIN_SHARED}),
near AS (SELECT a, b, shared, shared / (na + nb - shared) AS similarity FROM cand WHERE shared / (na + nb - shared) >= {K.SCAN_THRESHOLD}),
links AS (SELECT a, b FROM near UNION ALL SELECT rep, unit_id FROM classes WHERE unit_id <> rep AND n >= {K.MIN_SHARED})"""
_COMPONENTS = """link AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach(v, g) AS (SELECT DISTINCT x, x FROM link UNION SELECT link.y, reach.g FROM reach JOIN link ON link.x = reach.v WHERE reach.g < link.y),
labels AS (SELECT v AS unit_id, min(g) AS cluster FROM reach GROUP BY v)"""
_RANKED = f"""{_CULL}, {_FILES}, {_COMPONENTS},
m0 AS (SELECT u.*, files1.file, cluster FROM labels JOIN units1 u USING (unit_id) LEFT JOIN files1 USING (file_id)),
m1 AS (SELECT * FROM m0 x WHERE NOT EXISTS (SELECT 1 FROM m0 y WHERE y.cluster = x.cluster AND y.file_id = x.file_id AND y.start_byte <= x.start_byte AND y.end_byte >= x.end_byte AND (y.start_byte <> x.start_byte OR y.end_byte <> x.end_byte))),
m2 AS (SELECT * FROM m1 QUALIFY count(*) OVER (PARTITION BY cluster) > 1),
csize AS (SELECT cluster, count(*) AS size FROM m2 GROUP BY cluster),
cov AS (SELECT i.cluster AS i, j.cluster AS j, count(DISTINCT i.unit_id) AS n FROM m2 i JOIN m2 j ON i.file_id = j.file_id AND i.cluster <> j.cluster AND j.start_byte <= i.start_byte AND j.end_byte >= i.end_byte AND (j.start_byte <> i.start_byte OR j.end_byte <> i.end_byte) GROUP BY 1, 2),
gone AS (SELECT DISTINCT i AS cluster FROM cov JOIN csize ON csize.cluster = i WHERE n = size),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sig_lines DESC NULLS LAST, file NULLS FIRST, start_line NULLS FIRST, unit_id) AS rank FROM m2 WHERE cluster NOT IN (SELECT cluster FROM gone)),
repset AS (SELECT ranked.cluster, cfps AS rfps FROM ranked JOIN sets USING (unit_id) WHERE rank = 1),
members AS (SELECT ranked.cluster, ranked.unit_id, rank, sig_lines, is_test, is_trait_impl_method, file, start_line, rank = 1 AS representative, CASE WHEN rank = 1 THEN 1.0 ELSE len(list_intersect(cfps, rfps)) / (len(cfps) + len(rfps) - len(list_intersect(cfps, rfps))) END AS similarity FROM ranked JOIN sets USING (unit_id) JOIN repset USING (cluster)),
clusters AS (SELECT cluster, count(*) AS copies, coalesce(avg(similarity) FILTER (WHERE NOT representative), 1.0) AS similarity, coalesce(sum(sig_lines) FILTER (WHERE NOT representative), 0)::BIGINT AS deletable_lines,
  bool_and(coalesce(is_test, false)) AS test_only, bool_and(coalesce(is_trait_impl_method, false)) AS trait_impl_only, max(file) FILTER (WHERE representative) AS rep_file, max(start_line) FILTER (WHERE representative) AS rep_line FROM members GROUP BY cluster)"""
_GRADE = "CASE " + " ".join(f"WHEN {{0}} < {b} THEN '{g}'" for b, g in K.GRADES) + f" ELSE '{K.LAST_GRADE}' END"


def _culled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import materialize

    return materialize(pairs.cull(placed_units(table(spark, sf_dir, "units"), table(spark, sf_dir, "files"))), "culled-units")


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The culled units, one of each class of equal sets."""
    from .scratch import materialize

    return materialize(pairs.set_classes(_culled(spark, sf_dir))[1], "class-reps")


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment between classes; members decide what is nested."""
    from .scratch import materialize

    units = _culled(spark, sf_dir)
    members, reps = pairs.set_classes(units)
    return pairs.containment_pairs(materialize(reps, "class-reps"), members=members.join(units.select("unit_id", "file_id", "start_byte", "end_byte"), "unit_id"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _culled(spark, sf_dir)
    return clusters.ranked_members(units, pairs.similar_links(units))


# ---- filters and projections on files -------------------------------------------------------------------------------

@query(f"WITH {_FILES} SELECT file_id, CASE " + " ".join(f"WHEN split_part(file, '.', -1) IN ({', '.join(repr(e) for e in exts)}) THEN '{lang}'" for lang, exts in K.LANGUAGES.items()) + " END AS lang FROM files1")
def lang_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_rows(table(spark, sf_dir, "files")).select("file_id", paths.lang_of(F.col("file")).alias("lang"))


@query(f"WITH {_FILES} SELECT file_id, regexp_matches(lower(file), '{paths.EXCLUDED_RE}') AS excluded, regexp_matches(lower(file), '{paths.TEST_RE}') AS is_test FROM files1")
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_rows(table(spark, sf_dir, "files")).select("file_id", paths.default_excluded(F.col("file")).alias("excluded"), paths.is_test_path(F.col("file")).alias("is_test"))


_SKIPS = """lined AS (SELECT DISTINCT file_id, repo, content, CASE WHEN content = '' THEN [] WHEN suffix(content, chr(10)) THEN string_split_regex(content, '\\r?\\n')[:-2] ELSE string_split_regex(content, '\\r?\\n') END AS ls FROM files WHERE file_id IS NOT NULL),
skips AS (SELECT file_id, repo, len(ls) AS lines, CASE WHEN content IS NULL THEN 'non-utf8'
  WHEN regexp_matches(lower(array_to_string(ls[1:10], chr(10))), '@generated|do not edit|auto-generated|autogenerated|code generated by') THEN 'generated'
  WHEN len(list_filter(ls, lambda x: strlen(x) > 2000)) > 0 OR (len(ls) > 0 AND list_sum(list_transform(ls, lambda x: strlen(x))) // len(ls) > 300) THEN 'minified' END AS reason FROM lined)"""


@query(f"WITH {_SKIPS} SELECT file_id, reason FROM skips")
def content_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of a file differ in time alone: the verdict is made on each, so that no content is shuffled."""
    files = table(spark, sf_dir, "files").where("file_id is not null")
    return files.select("file_id", content.skip_reason(F.col("content")).alias("reason")).distinct()


@query(f"WITH {_SKIPS} SELECT repo, count(*) AS files, coalesce(sum(lines), 0)::BIGINT AS total_lines, count_if(reason = 'generated') AS skipped_generated, count_if(reason = 'minified') AS skipped_minified, count_if(reason = 'non-utf8') AS skipped_non_utf8 FROM skips GROUP BY repo")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where("file_id is not null")
    rows = files.select("file_id", "repo", F.size(content.lines(F.col("content"))).alias("n"), content.skip_reason(F.col("content")).alias("reason")).distinct()
    count = lambda r: F.count_if(F.col("reason") == r).alias("skipped_" + r.replace("-", "_"))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(F.col("n") >= 0, F.col("n"))), F.lit(0)).alias("total_lines"), count("generated"), count("minified"), count("non-utf8"))


@query(f"""WITH {_FILES}, lined AS (SELECT file_id, max(CASE WHEN content IS NULL THEN 0 WHEN content = '' THEN 0 ELSE len(string_split_regex(content, '\\r?\\n')) - suffix(content, chr(10))::INT END) AS n FROM files WHERE file_id IS NOT NULL GROUP BY file_id),
run AS (SELECT file, file_id, n, coalesce(sum(n) OVER (ORDER BY file, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files1 JOIN lined USING (file_id))
SELECT file_id, file, n::BIGINT AS n FROM run WHERE before < 5000""")
def pick_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, by path, that reach 5,000 lines."""
    files = table(spark, sf_dir, "files")
    n = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.coalesce(F.size(content.lines(F.col("content"))), F.lit(0))).alias("n")).withColumn("n", F.greatest(F.lit(0), "n").cast("long"))
    rows = file_rows(files).join(n, "file_id").withColumn("at", F.struct("file", "file_id"))
    return history.prefix_until(rows, order="at", size="n", target=5000).select("file_id", "file", "n")


# ---- tokens and fingerprints of documents ----------------------------------------------------------------------------

_TOKENS = """toks AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'NUM' ELSE t END) AS t0 FROM documents),
codes AS (SELECT doc_id, list_filter(t0, lambda t, i: NOT (t = 'NUM' AND i > 1 AND t0[i - 1] = 'NUM')) AS t FROM toks)"""
_GRAMS = f"""{_TOKENS}, grams AS (SELECT doc_id AS id, pos, md5(array_to_string(t[pos:pos + {K.KGRAM - 1}], ' ')) AS hash FROM (SELECT doc_id, t, unnest(range(1, len(t) - {K.KGRAM - 2})) AS pos FROM codes WHERE len(t) >= {K.KGRAM})),
picked AS (SELECT id, pos, min({{'h': hash, 'p': -pos}}) OVER w AS least, count(*) OVER w AS width, count(*) OVER (PARTITION BY id) AS n FROM grams WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K.WINDOW - 1} FOLLOWING)),
won AS (SELECT DISTINCT id, least.h AS fp FROM picked WHERE width = {K.WINDOW} OR (n < {K.WINDOW} AND pos = 1))"""


@query(f"WITH {_TOKENS} SELECT doc_id, len(t0) AS words, len(t) AS codes, len(list_filter(t, lambda x: x = 'NUM')) AS numbers FROM (SELECT * FROM toks JOIN codes USING (doc_id))")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokens.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text")
    return d.select(F.col("id").alias("doc_id"), F.size("words").cast("long").alias("words"), F.size("codes").cast("long").alias("codes"), F.size(F.filter("codes", lambda x: x == "NUM")).cast("long").alias("numbers"))


@query(f"WITH {_GRAMS} SELECT id, fp FROM won")
def doc_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", F.explode("fps").alias("fp"))


@query(f"WITH {_GRAMS}, a AS (SELECT id, count(*) AS kgrams FROM grams GROUP BY id), b AS (SELECT id, count(*) AS fps FROM won GROUP BY id) SELECT id, kgrams, fps, round(fps / kgrams, 6) AS density FROM a JOIN b USING (id)")
def doc_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text").where("kgrams > 0").withColumn("fps", F.size("fps").cast("long"))
    return d.select("id", "kgrams", "fps", r6(F.col("fps") / F.col("kgrams")).alias("density"))


# ---- set joins of units ----------------------------------------------------------------------------------------------

@query(f"WITH {_CULL.replace(f'greatest({K.CULL_FLOOR},', 'greatest(10,')} SELECT lang, fp, df FROM hot")
def cull_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a floor of 10, as no fingerprint of the smaller tables is beyond 100."""
    return pairs.hot_fingerprints(unit_rows(table(spark, sf_dir, "units")), floor=10)


@query(f"WITH {_CULL} SELECT u.unit_id, len(u.fps) AS before, coalesce(n, CASE WHEN u.lang IS NULL THEN len(u.fps) ELSE 0 END) AS after FROM units1 u LEFT JOIN classes USING (unit_id)")
def cull_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_rows(table(spark, sf_dir, "units"))
    return pairs.cull(units.withColumn("n", F.size("fps"))).select("unit_id", F.col("n").cast("long").alias("before"), F.size("fps").cast("long").alias("after"))


@query(f"WITH {_CULL} SELECT unit_id, rep FROM classes")
def set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with equal sets, by their least one; the pair queries are between these."""
    return pairs.set_classes(pairs.cull(unit_rows(table(spark, sf_dir, "units"))))[0]


@query(f"WITH {_CULL} SELECT a, b, shared FROM cand")
def pairs_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidate_pairs(_reps(spark, sf_dir))


@query(f"WITH {_CULL} SELECT a, b, shared, round(similarity, 6) AS similarity FROM near")
def pairs_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.jaccard_pairs(_reps(spark, sf_dir)).select("a", "b", F.col("shared").cast("long").alias("shared"), r6(F.col("similarity")).alias("similarity"))


_CONTAINED = f"""{_CULL}, sided AS (SELECT CASE WHEN na <= nb THEN a ELSE b END AS small, CASE WHEN na <= nb THEN b ELSE a END AS large, shared / least(na, nb) AS containment FROM cand WHERE shared / (na + nb - shared) < {K.SCAN_THRESHOLD} AND shared / least(na, nb) >= {K.CONTAINMENT}),
contained AS (SELECT small, large, containment FROM sided JOIN units1 s ON s.unit_id = small JOIN units1 l ON l.unit_id = large
  WHERE NOT coalesce(s.file_id = l.file_id AND ((s.start_byte >= l.start_byte AND s.end_byte <= l.end_byte) OR (l.start_byte >= s.start_byte AND l.end_byte <= s.end_byte)), false))"""


@query(f"WITH {_CONTAINED} SELECT small, large, round(containment, 6) AS containment FROM contained")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contained(spark, sf_dir).withColumn("containment", r6(F.col("containment")))


@query(f"WITH {_CONTAINED} SELECT small, large, round(containment, 6) AS containment FROM contained QUALIFY row_number() OVER (PARTITION BY small ORDER BY containment DESC, large) = 1")
def best_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.best_container(_contained(spark, sf_dir)).withColumn("containment", r6(F.col("containment")))


# ---- clusters and score ----------------------------------------------------------------------------------------------

@query(f"WITH RECURSIVE {_CULL}, {_COMPONENTS} SELECT unit_id, cluster FROM labels")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = pairs.cull(unit_rows(table(spark, sf_dir, "units")))
    return graph.components(pairs.similar_links(units)).select(F.col("v").alias("unit_id"), F.col("label").alias("cluster"))


@query(f"WITH RECURSIVE {_RANKED} SELECT cluster, unit_id, rank::BIGINT AS rank, representative, round(similarity, 6) AS similarity FROM members")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_rank(_ranked(spark, sf_dir)).select("cluster", "unit_id", F.col("rank").cast("long").alias("rank"), "representative", r6(F.col("similarity")).alias("similarity"))


@query(f"WITH RECURSIVE {_RANKED} SELECT cluster, copies, round(similarity, 6) AS similarity, deletable_lines, test_only, trait_impl_only FROM clusters")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_rows(_ranked(spark, sf_dir)).select("cluster", "copies", r6(F.col("similarity")).alias("similarity"), "deletable_lines", "test_only", "trait_impl_only")


@query(f"WITH RECURSIVE {_RANKED} SELECT cluster, copies, deletable_lines FROM clusters ORDER BY deletable_lines DESC, rep_file NULLS FIRST, rep_line NULLS FIRST, cluster LIMIT {K.TOP_CLUSTERS}")
def clusters_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's ten largest clusters."""
    return clusters.top_clusters(clusters.cluster_rows(_ranked(spark, sf_dir)), K.TOP_CLUSTERS).select("cluster", "copies", "deletable_lines")


@query(f"WITH RECURSIVE {_RANKED}, total AS (SELECT sum(sig_lines) AS s FROM units1), del AS (SELECT coalesce(sum(deletable_lines) FILTER (WHERE NOT trait_impl_only AND NOT test_only), 0)::BIGINT AS d FROM clusters), pct AS (SELECT d, CASE WHEN s > 0 THEN d * 100.0 / s ELSE 0.0 END AS p FROM del, total) SELECT d AS deletable_lines, round(p, 6) AS percent, {_GRADE.format('p')} AS grade FROM pct")
def slop_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the significant lines of all units."""
    total = unit_rows(table(spark, sf_dir, "units")).agg(F.coalesce(F.sum("sig_lines"), F.lit(0)).alias("s")).first().s
    return clusters.score(clusters.cluster_rows(_ranked(spark, sf_dir)), F.lit(total)).withColumn("percent", r6(F.col("percent")))


@query(f"SELECT DISTINCT repo, \"commit\", slop_percent, CASE WHEN slop_percent IS NOT NULL THEN {_GRADE.format('slop_percent')} END AS grade FROM points")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "points").select("repo", "commit", "slop_percent", scalars.grade(F.col("slop_percent")).alias("grade")).distinct()


# ---- check -----------------------------------------------------------------------------------------------------------

_PROBED = f"""{_UNITS}, {_FILES}, placed AS (SELECT u.*, file FROM units1 u LEFT JOIN files1 USING (file_id)),
fp AS (SELECT unit_id, lang, batch_no, unnest(fps) AS f FROM units1 WHERE lang IS NOT NULL),
hit AS (SELECT c.unit_id, o.unit_id AS original_id, count(*) AS i FROM fp c JOIN fp o ON c.lang = o.lang AND c.f = o.f WHERE c.batch_no > 0 AND o.batch_no = 0 GROUP BY 1, 2),
sim AS (SELECT hit.unit_id, original_id, i / (len(c.fps) + len(o.fps) - i) AS similarity FROM hit JOIN units1 c ON c.unit_id = hit.unit_id JOIN units1 o ON o.unit_id = original_id),
best AS (SELECT * FROM sim WHERE similarity >= {K.CHECK_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY similarity DESC, original_id) = 1),
found AS (SELECT best.*, c.file, c.name, c.start_line AS line, o.file AS original_file, o.name AS original_name, o.start_line AS original_line, o.fps AS original_fps FROM best JOIN placed c USING (unit_id) JOIN placed o ON o.unit_id = original_id)"""


def _probed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matches of all later batches against the first, with both places, and the later units."""
    units = placed_units(table(spark, sf_dir, "units"), table(spark, sf_dir, "files"))
    changed, base = units.where("batch_no > 0"), units.where("batch_no = 0")
    best = pairs.probe_pairs(changed, base)
    mine = changed.select("unit_id", "lang", "file", "name", F.col("start_line").alias("line"))
    theirs = base.select(F.col("unit_id").alias("original_id"), F.col("file").alias("original_file"), F.col("name").alias("original_name"), F.col("start_line").alias("original_line"), F.col("fps").alias("original_fps"))
    return best.join(mine, "unit_id").join(theirs, "original_id"), changed


@query(f"WITH {_PROBED} SELECT unit_id, original_id, round(similarity, 6) AS similarity FROM best")
def check_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir)[0].select("unit_id", "original_id", r6(F.col("similarity")).alias("similarity"))


@query(f"""WITH {_PROBED}, other AS (SELECT * FROM found WHERE NOT coalesce(file = original_file AND name = original_name, false)),
kept AS (SELECT * FROM other WHERE original_file IS NULL OR original_file NOT IN (SELECT file FROM placed WHERE batch_no > 0 AND file IS NOT NULL)
  OR EXISTS (SELECT 1 FROM placed n WHERE n.batch_no > 0 AND n.file = original_file AND len(n.fps) + len(original_fps) > 0 AND len(list_intersect(n.fps, original_fps)) / (len(n.fps) + len(original_fps) - len(list_intersect(n.fps, original_fps))) >= {K.MOVE_EQUIVALENCE}))
SELECT unit_id, file, name, line, original_file, original_name, original_line, round(similarity, 6) AS similarity FROM kept""")
def check_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a function's own earlier self, and without originals that were moved away."""
    found, changed = _probed(spark, sf_dir)
    files = changed.where("file is not null").select("file")
    kept = check.without_moves(check.without_same_function(found), changed.where("file is not null").select("file", "fps"), files)
    return kept.select("unit_id", "file", "name", "line", "original_file", "original_name", "original_line", r6(F.col("similarity")).alias("similarity"))


@query(f"WITH {_UNITS}, {_FILES}, hunks AS (SELECT DISTINCT {_PATH.format('file')} AS path, line FROM findings) SELECT unit_id FROM units1 JOIN files1 USING (file_id) WHERE EXISTS (SELECT 1 FROM hunks WHERE path = file AND start_line <= line AND end_line >= line)")
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that hold a reported line."""
    hunks = table(spark, sf_dir, "findings").select(compared_path(F.col("file")).alias("path"), F.col("line").alias("start"), F.col("line").alias("end")).distinct()
    return check.touched(placed_units(table(spark, sf_dir, "units"), table(spark, sf_dir, "files")), hunks).select("unit_id")


@query(f"WITH f AS (SELECT batch_no, finding_id, {_PATH.format('file')} AS path, line FROM findings) SELECT batch_no AS diff, path, line AS start, line + 1 AS \"end\" FROM f WHERE path IS NOT NULL AND line IS NOT NULL")
def parse_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs written from the findings of a batch (a file line and a hunk of two lines each), read back."""
    f = table(spark, sf_dir, "findings").select("batch_no", "finding_id", compared_path(F.col("file")).alias("path"), "line").where("path is not null and line is not null")
    text = F.array(F.concat(F.lit("+++ b/"), "path"), F.concat(F.lit("@@ -0,0 +"), F.col("line").cast("string"), F.lit(",2 @@ x")), F.lit("+code"))
    lines = f.select(F.col("batch_no").alias("diff"), "finding_id", F.posexplode(text).alias("i", "text")).select("diff", (F.col("finding_id") * 3 + F.col("i")).alias("n"), F.col("text").alias("line"))
    return check.parse_hunks(lines)


_SUGGEST = f"""f AS (SELECT finding_id, {_PATH.format('file')} AS file, {_PATH.format('original_file')} AS o, original_name AS name FROM findings),
p AS (SELECT *, string_split(regexp_replace(o, '\\.rs$', ''), '/') AS rp, string_split(regexp_replace(o, '\\.pyi?$', ''), '/') AS pp, string_split(file, '/')[:-2] AS here, string_split(regexp_replace(o, '\\.[^./]*$', ''), '/') AS there FROM f),
q AS (SELECT *, CASE WHEN list_contains(rp, 'src') THEN rp[len(rp) - list_position(list_reverse(rp), 'src') + 2:] ELSE rp END AS ra, CASE WHEN pp[1] = 'src' THEN pp[2:] ELSE pp END AS pa,
  len(list_filter(range(1, least(len(here), len(there) - 1) + 1), lambda i: here[:i] = there[:i])) AS common FROM p),
s AS (SELECT finding_id, split_part(o, '.', -1) AS ext, name, array_to_string(CASE WHEN ra[-1] IN ('mod', 'lib', 'main') THEN ra[:-2] ELSE ra END, '::') AS rpath, array_to_string(CASE WHEN pa[-1] = '__init__' THEN pa[:-2] ELSE pa END, '.') AS dotted,
  array_to_string(list_concat(list_transform(range(len(here) - common), lambda x: '..'), there[common + 1:]), '/') AS rel FROM q)"""


@query(f"""WITH {_SUGGEST} SELECT finding_id, CASE WHEN ext = 'rs' THEN 'use crate::' || CASE WHEN rpath = '' THEN '' ELSE rpath || '::' END || name || ';'
  WHEN ext IN ('py', 'pyi') AND dotted <> '' THEN 'from ' || dotted || ' import ' || name
  WHEN ext IN ('ts', 'mts', 'cts', 'tsx', 'js', 'mjs', 'cjs', 'jsx') THEN 'import {{ ' || name || ' }} from ''' || CASE WHEN starts_with(rel, '..') THEN rel ELSE './' || rel END || ''';' END AS suggestion FROM s""")
def import_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "findings").select("finding_id", compared_path(F.col("file")).alias("file"), compared_path(F.col("original_file")).alias("o"), "original_name")
    return f.select("finding_id", scalars.import_suggestion(paths.lang_of(F.col("o")), F.col("o"), F.col("original_name"), F.col("file")).alias("suggestion"))


# ---- history ---------------------------------------------------------------------------------------------------------

_POINTS = 'pts AS (SELECT repo, "commit", min(committed_at) AS at_, max(slop_percent) AS v FROM points GROUP BY 1, 2)'


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "points").groupBy("repo", "commit").agg(F.min("committed_at").alias("at_"), F.max("slop_percent").alias("v"))


@query(f"""WITH {_POINTS}, m AS (SELECT *, strftime(at_, '%Y-%m') AS month FROM pts) SELECT repo, "commit", month FROM m QUALIFY lead(month) OVER (PARTITION BY repo ORDER BY at_) IS DISTINCT FROM month OR lead(1) OVER (PARTITION BY repo ORDER BY at_) IS NULL""")
def month_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.month_last(_points(spark, sf_dir), group="repo", order="at_", month=scalars.month_of(F.unix_timestamp("at_"))).select("repo", "commit", "month")


@query(f"""WITH {_POINTS}, i AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY at_) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM pts)
SELECT repo, "commit" FROM i WHERE n <= 6 OR i IN (0, (n - 1) // 5, 2 * (n - 1) // 5, 3 * (n - 1) // 5, 4 * (n - 1) // 5, n - 1)""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six snapshots a repository."""
    return history.evenly_spaced(_points(spark, sf_dir), group="repo", order="at_", most=6).select("repo", "commit")


@query(f"""WITH {_POINTS} SELECT repo, "commit", round(avg(v) OVER (PARTITION BY repo ORDER BY at_ ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM pts""")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.smooth(_points(spark, sf_dir), group="repo", order="at_", value="v").select("repo", "commit", r6(F.col("smoothed")).alias("smoothed"))


@query(f"""WITH {_POINTS}, s AS (SELECT repo, v, strftime(at_, '%Y-%m') AS d, row_number() OVER w AS i, avg(v) OVER (PARTITION BY repo ORDER BY at_ ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM pts WHERE v IS NOT NULL WINDOW w AS (PARTITION BY repo ORDER BY at_)),
g AS (SELECT repo, count(*) AS n, arg_max(s, i) AS cur, min({{'s': s, 'i': i, 'd': d}}) AS low, max(i) FILTER (WHERE v <= 0.05) AS ci, arg_max(d, i) FILTER (WHERE v <= 0.05) AS cd, arg_min(d, i) AS fd FROM s GROUP BY repo)
SELECT repo, round(CASE WHEN n >= 3 AND low.s > 0.05 AND cur / low.s >= 1.5 AND low.i < n THEN cur / low.s END, 6) AS growth_factor,
  CASE WHEN n >= 3 AND low.s > 0.05 AND cur / low.s >= 1.5 AND low.i < n THEN low.d WHEN n >= 3 AND low.s <= 0.05 AND cur >= 1 AND coalesce(ci, 1) < n THEN coalesce(cd, fd) END AS growth_since FROM g""")
def inflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("d", scalars.month_of(F.unix_timestamp("at_")))
    return history.inflection(p, group="repo", order="at_", value="v", date="d").select("repo", r6(F.col("growth_factor")).alias("growth_factor"), "growth_since")


@query(f"""WITH {_POINTS} SELECT lower(oid) AS oid, arg_min("commit", (at_, "commit")) AS "commit" FROM tree_entries JOIN pts USING ("commit") WHERE oid IS NOT NULL GROUP BY 1""")
def fresh_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which snapshot brings which blob."""
    return history.fresh_blobs(table(spark, sf_dir, "tree_entries"), snapshots=small(_points(spark, sf_dir).select("commit", F.col("at_").alias("at")), 100_000))


@query("""WITH pts AS (SELECT repo, "commit", min(committed_at) AS t FROM points GROUP BY 1, 2),
known AS (SELECT * FROM pts WHERE "commit" IN (SELECT "commit" FROM tree_entries)),
steps AS (SELECT lag("commit") OVER (PARTITION BY repo ORDER BY t, "commit") AS old, "commit" AS new FROM known),
held AS (SELECT "commit", regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS p, arg_max(lower(oid), delivered_at) AS oid
  FROM tree_entries WHERE oid IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
was AS (SELECT new, p, oid FROM steps JOIN held ON held."commit" = old WHERE old IS NOT NULL),
now AS (SELECT new, p, oid FROM steps JOIN held ON held."commit" = new WHERE old IS NOT NULL)
SELECT new AS "commit", p AS path, CASE WHEN was.oid IS NULL THEN 'added' WHEN now.oid IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM was FULL JOIN now USING (new, p) WHERE was.oid IS DISTINCT FROM now.oid""")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "tree_entries")
    steps = transitions(table(spark, sf_dir, "points"), tree.select("commit").distinct())
    out = snapshot_changes(tree, steps, snapshot="commit", key=compared_path(F.col("path")), value=F.lower("oid"), version=F.col("delivered_at"))
    return out.select(F.col("snapshot").alias("commit"), F.col("key").alias("path"), "change")


# ---- metrics ---------------------------------------------------------------------------------------------------------

_PREDICTED = "pred AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.similar_links(pairs.cull(unit_rows(table(spark, sf_dir, "units"))))


@query(f"""WITH {_CULL}, {_PREDICTED}, c AS (SELECT count_if(links.a IS NOT NULL AND pred.a IS NOT NULL) AS tp, count_if(links.a IS NULL) AS fp, count_if(pred.a IS NULL) AS fn FROM links FULL JOIN pred ON links.a = pred.a AND links.b = pred.b),
n AS (SELECT count(*) AS n FROM units1), d AS (SELECT tp, fp, fn, n * (n - 1) // 2 - tp - fp - fn AS tn FROM c, n),
e AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM d)
SELECT tp, fp, fn, tn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
 round(CASE WHEN (tp + fp) > 0 AND (tp + fn) > 0 AND (tn + fp) > 0 AND (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0 END, 6) AS mcc FROM e""")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collected pairs as a detector's, against the links of the exact join (similar representatives, copies with theirs)."""
    n = table(spark, sf_dir, "units").where("unit_id is not null").select("unit_id").distinct().count()
    out = metrics.scores(metrics.confusion(_truth(spark, sf_dir), table(spark, sf_dir, "pairs"), n))
    return out.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mcc")])


@query(f"WITH {_CULL}, {_PREDICTED}, t AS (SELECT links.a, links.b, lang FROM links JOIN units1 ON unit_id = links.a) SELECT lang, count(pred.a) AS hit, count(*) AS total, round(count(pred.a) / count(*), 6) AS recall FROM t LEFT JOIN pred USING (a, b) GROUP BY lang")
def recall_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_rows(table(spark, sf_dir, "units"))
    truth = _truth(spark, sf_dir).join(units.select(F.col("unit_id").alias("a"), "lang"), "a")
    return metrics.recall_by(truth, table(spark, sf_dir, "pairs"), "lang").withColumn("recall", r6(F.col("recall")))


# The same two over all true pairs: every two of a class and of two similar classes, not one link a copy.
_ALL_TRUE = f"""{_CULL}, owned AS (SELECT unit_id, rep, lang FROM classes JOIN units1 USING (unit_id) WHERE n >= {K.MIN_SHARED}),
every AS (SELECT x.unit_id AS a, y.unit_id AS b, x.lang FROM owned x JOIN owned y ON x.rep = y.rep AND x.unit_id < y.unit_id
  UNION ALL SELECT least(x.unit_id, y.unit_id), greatest(x.unit_id, y.unit_id), x.lang FROM near JOIN owned x ON x.rep = near.a JOIN owned y ON y.rep = near.b)"""


def _true_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members of the classes that can be similar at all, with their language, and the similar pairs of classes."""
    from .scratch import materialize

    units = _culled(spark, sf_dir).where(F.size("fps") >= K.MIN_SHARED)
    members, reps = pairs.set_classes(units)
    return materialize(members.join(units.select("unit_id", "lang"), "unit_id"), "class-members"), materialize(pairs.jaccard_pairs(reps).select("a", "b"), "class-pairs")


@query(SQL["detector_scores"].replace(_CULL, _ALL_TRUE, 1).replace("links.", "every.").replace("FROM links FULL", "FROM every FULL"))
def detector_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``detector_scores`` against all true pairs."""
    n = table(spark, sf_dir, "units").where("unit_id is not null").select("unit_id").distinct().count()
    members, similar = _true_classes(spark, sf_dir)
    out = metrics.scores(metrics.class_confusion(members, similar, table(spark, sf_dir, "pairs"), n))
    return out.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mcc")])


@query(f"WITH {_ALL_TRUE}, {_PREDICTED} SELECT lang, count(pred.a) AS hit, count(*) AS total, round(count(pred.a) / count(*), 6) AS recall FROM every LEFT JOIN pred USING (a, b) GROUP BY lang")
def recall_by_lang_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recall_by_lang`` over all true pairs."""
    members, similar = _true_classes(spark, sf_dir)
    return metrics.class_recall(members, similar, table(spark, sf_dir, "pairs"), "lang").withColumn("recall", r6(F.col("recall")))


@query("""WITH p AS (SELECT DISTINCT strftime(found_at, '%Y') AS run, least(a, b) AS a, greatest(a, b) AS b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT run, count(*) AS n FROM p GROUP BY run),
two AS (SELECT x.run AS r, y.run AS q, x.n AS n, y.n AS m FROM s x JOIN s y ON x.run < y.run), c AS (SELECT x.run AS r, y.run AS q, count(*) AS c FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND x.run < y.run GROUP BY 1, 2)
SELECT (SELECT count(*) FROM s) AS runs, round(coalesce(avg(coalesce(c, 0) / (n + m - coalesce(c, 0))), 1.0), 6) AS determinism FROM two LEFT JOIN c USING (r, q)""")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each year as a run."""
    runs = table(spark, sf_dir, "pairs").where("a is not null and b is not null").withColumn("run", F.date_format("found_at", "yyyy"))
    return metrics.determinism(runs).select("runs", r6(F.col("determinism")).alias("determinism"))


@query("""WITH s AS (SELECT DISTINCT * FROM scan_stats) SELECT repo, count(*) AS runs, round(avg(elapsed_ms), 6) AS elapsed_ms_mean, round(CASE WHEN count(elapsed_ms) > 0 THEN coalesce(stddev_samp(elapsed_ms), 0) END, 6) AS elapsed_ms_stddev,
round(avg(functions), 6) AS functions_mean, round(CASE WHEN count(functions) > 0 THEN coalesce(stddev_samp(functions), 0) END, 6) AS functions_stddev, round(CASE WHEN sum(functions) > 0 THEN sum(elapsed_ms) / sum(functions) END, 6) AS cost_per_hit FROM s GROUP BY repo""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_summary(table(spark, sf_dir, "scan_stats").distinct(), group="repo", values=["elapsed_ms", "functions"], cost="elapsed_ms", found="functions")
    return out.select("repo", "runs", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query(f"""WITH {_UNITS}, {_FILES}, truth AS (SELECT split_part(file, '/', -1) AS base, name, min(unit_id) AS truth_id FROM units1 JOIN files1 USING (file_id) GROUP BY 1, 2)
SELECT finding_id, truth_id FROM findings LEFT JOIN truth ON base = split_part({_PATH.format('original_file')}, '/', -1) AND name = original_name""".replace("AND name = original_name", "AND truth.name = original_name"))
def truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported originals by file name and function name."""
    units = placed_units(table(spark, sf_dir, "units"), table(spark, sf_dir, "files")).where("file is not null")
    reported = table(spark, sf_dir, "findings").select("finding_id", compared_path(F.col("original_file")).alias("file"), F.col("original_name").alias("name"))
    return metrics.match_truth(reported, units.select(F.col("unit_id").alias("id"), "file", "name")).select("finding_id", "truth_id")


# ---- report functions ------------------------------------------------------------------------------------------------

@query("""SELECT DISTINCT scan_id, format('{:,}', total_lines) AS total_lines, CASE WHEN elapsed_ms < 1000 THEN elapsed_ms || 'ms' ELSE format('{:.1f}', elapsed_ms / 1000.0) || 's' END AS took,
CASE WHEN length(repo) <= 12 THEN repo ELSE repo[:11] || '…' END AS short, CASE WHEN length(repo) <= 12 THEN repo ELSE '…' || repo[-11:] END AS tail FROM scan_stats""")
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "scan_stats")
    return s.select("scan_id", scalars.group_digits(F.col("total_lines")).alias("total_lines"), scalars.human_ms(F.col("elapsed_ms")).alias("took"),
                    scalars.truncate(F.col("repo"), 12).alias("short"), scalars.truncate_left(F.col("repo"), 12).alias("tail")).distinct()


@query("""WITH e AS (SELECT finding_id, CASE WHEN similarity IS NOT NULL THEN floor(greatest(0.0, least(1.0, similarity)) * 72 + 0.5)::INT END AS e FROM findings) SELECT finding_id, repeat('█', (e // 8)::INT) || CASE WHEN e // 8 < 9 THEN ['', '▏', '▎', '▍', '▌', '▋', '▊', '▉'][e % 8 + 1] ELSE '' END AS bar FROM e""")
def similarity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "findings").select("finding_id", scalars.sim_bar(F.col("similarity")).alias("bar"))


# ---- code: files to functions, without SQL -----------------------------------------------------------------------------


def _scan(spark: SparkSession, sf_dir: str, shapes: bool = False):
    """A scan of the files table: a file of a repository is one named by both."""
    from .plans.config import Config
    from .plans.scan import Scan

    files = table(spark, sf_dir, "files").where("path is not null").select(F.concat_ws("/", "repo", compared_path(F.col("path"))).alias("file"), F.col("size_bytes").alias("size"), "content")
    return Scan(files, Config(min_tokens=20), shapes=shapes)


@query()
def scan_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function of every scannable file."""
    return _scan(spark, sf_dir).units.select("file", "lang", "name", "start_line", "end_line", "sig_lines", F.size("fps").alias("fingerprints"), "is_test")


@query()
def scan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of near-duplicate functions of the files."""
    return _scan(spark, sf_dir).clusters


@query()
def scan_class_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters of C# types with like signatures."""
    return _scan(spark, sf_dir, shapes=True).shape_members.select("cluster", "file", "name", "sig_lines", "representative", "similarity")


@query()
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of the units table as JSON documents, numbered by rank."""
    from .plans.report import cluster_json

    members = _ranked(spark, sf_dir)
    return cluster_json(members, clusters.cluster_rows(members))
