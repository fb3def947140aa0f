"""Queries on records, pieces, exclusions and texts: the catalogue, its splits and its audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.functions import text as X
from scorelake.operators import quality as Q
from scorelake.operators import sampling as R
from scorelake.operators.sequences import fingerprint, train_windows
from scorelake.operators.statistics import agreement, contingency
from scorelake.plans.common import Catalogue
from scorelake.sources.catalogs import filename_fields, resolve_paths
from scorelake.sources.relations import EVENTS_SQL, METRICS_SQL, PIECES_SQL, RECORDS_SQL, TOKENS_SQL, events, metrics, pieces, records, tokens
from scorelake.sources.tables import table

C = Catalogue()
REC, PCS, TOK = f"WITH {RECORDS_SQL} ", f"WITH {PIECES_SQL} ", f"WITH {TOKENS_SQL} "


def rule_sql(text: str, rules: dict[str, list[str]], default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules.items())
    return f"CASE {whens} ELSE '{default}' END"


PLAIN_SQL = "translate(lower(title), '- ', '__')"
COMPOSER_SQL = f"coalesce(nullif(trim(composer), ''), {rule_sql('''translate(lower(path), '- ', '__')''', X.COMPOSERS, 'Unknown')})"


@C.add("stx01_plain", REC + "SELECT piece_id, translate(lower(title), '- ', '__') AS plain FROM records")
def stx01(spark, d):
    return records(spark, d).select("piece_id", X.plain(F.col("title")).alias("plain"))


@C.add("stx02_composers", REC + f"SELECT piece_id, {COMPOSER_SQL} AS composer, {rule_sql(PLAIN_SQL, X.COMPOSERS, 'Unknown')} AS told_by_title FROM records WHERE title IS NOT NULL")
def stx02(spark, d):
    return records(spark, d).where("title is not null").select(
        "piece_id", X.composer(F.col("path"), F.col("composer")).alias("composer"), X.first_match(X.plain(F.col("title")), X.COMPOSERS, "Unknown").alias("told_by_title")
    )


@C.add("stx03_rules", f"""WITH {RECORDS_SQL}, {EVENTS_SQL}, n AS (SELECT piece_id, count(*) AS notes, count(*) / nullif(count(DISTINCT measure), 0) AS per FROM ev GROUP BY 1)
  SELECT piece_id, {rule_sql(PLAIN_SQL, X.FORMS, 'piece')} AS form, {rule_sql(PLAIN_SQL, X.ARRANGEMENTS, 'standard')} AS arrangement,
  CASE WHEN contains({PLAIN_SQL}, 'easy') OR contains({PLAIN_SQL}, 'beginner') THEN 'easy' WHEN notes >= 900 OR per >= 7.5 THEN 'advanced' WHEN notes <= 120 AND per <= 3.0 THEN 'easy'
    WHEN notes >= 350 OR per >= 4.5 THEN 'intermediate-advanced' ELSE 'intermediate' END AS difficulty FROM records JOIN n USING (piece_id) WHERE title IS NOT NULL""")
def stx03(spark, d):
    """Form, arrangement and difficulty by ordered rules."""
    n = events(spark, d).groupBy("piece_id").agg(F.count(F.lit(1)).alias("notes"), F.try_divide(F.count(F.lit(1)), F.countDistinct("measure")).alias("per"))
    t = F.col("title")
    return records(spark, d).where("title is not null").join(n, "piece_id").select(
        "piece_id", X.form(t).alias("form"), X.arrangement(t).alias("arrangement"), X.difficulty(t, F.col("notes"), F.col("per")).alias("difficulty")
    )


@C.add("stx04_slug_titles", "SELECT DISTINCT source_path, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(source_path, '^.*/', ''), '[_-]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM prepared_pieces WHERE source_path IS NOT NULL")
def stx04(spark, d):
    return table(spark, d, "prepared_pieces").where("source_path is not null").select("source_path", X.slug_title(F.regexp_replace("source_path", "^.*/", "")).alias("title")).distinct()


STEM_SQL = r"regexp_replace(regexp_extract(regexp_replace({x}, '/+$', ''), '([^/]*)$', 1), '([^.])\.[^.]*$', '\1')"
CANON_SQL = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(" + STEM_SQL + r"), '[_.\-]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN " + str(Q.NOISE) + "), ' ')"


@C.add("stx05_stems", REC + f"SELECT piece_id, {STEM_SQL.format(x='path')} AS stem, regexp_extract(path, '([^/]*)$', 1) AS name FROM records")
def stx05(spark, d):
    return records(spark, d).select("piece_id", Q.stem(F.col("path")).alias("stem"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


@C.add("stx06_canonical_works", REC + f"SELECT piece_id, {CANON_SQL.format(x='title')} AS work FROM records WHERE title IS NOT NULL")
def stx06(spark, d):
    return records(spark, d).where("title is not null").select("piece_id", Q.canonical_work(F.col("title")).alias("work"))


KEY_SQL = f"regexp_replace(lower(strip_accents({CANON_SQL.format(x='title')})), '[^a-z0-9]+', '', 'g')"


@C.add("stx07_label_flags", REC + f"""SELECT piece_id, {CANON_SQL.format(x='title')} = '' AS is_empty, {CANON_SQL.format(x='title')} IN {Q.GENERIC} AS is_generic,
  {CANON_SQL.format(x='title')} <> '' AND NOT contains({CANON_SQL.format(x='title')}, ' ') AS is_short, regexp_matches(regexp_extract(title, '([^/]*)$', 1), '[^.]\\.[^.]+$') AS dropped_suffix FROM records WHERE title IS NOT NULL""")
def stx07(spark, d):
    work = Q.canonical_work(F.col("title"))
    return records(spark, d).where("title is not null").select(
        "piece_id", (work == "").alias("is_empty"), work.isin(*Q.GENERIC).alias("is_generic"), ((work != "") & ~F.contains(work, F.lit(" "))).alias("is_short"),
        (Q.suffix(F.col("title")) != "").alias("dropped_suffix"),
    )


@C.add("stx09_label_parts", "SELECT token, split_part(label, '|', 1) AS pitch, split_part(split_part(label, '|', 2), '=', 2) AS duration FROM token_vocabulary")
def stx09(spark, d):
    return table(spark, d, "token_vocabulary").select("token", F.substring_index("label", "|", 1).alias("pitch"), F.substring_index("label", "=", -1).alias("duration"))


@C.add("stx10_top_items", TOK + """, c AS (SELECT piece_id, token, count(*) AS n FROM tok GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY n DESC, token DESC) AS rn FROM c)
  SELECT piece_id, array_to_string(list(CAST(token AS VARCHAR) ORDER BY rn), ' ') AS top FROM r WHERE rn <= 3 GROUP BY 1""")
def stx10(spark, d):
    """The commonest tokens of each piece."""
    by = Window.partitionBy("piece_id").orderBy(F.desc("n"), F.desc("token"))
    counts = tokens(spark, d).groupBy("piece_id", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("rn", F.row_number().over(by)).where("rn <= 3")
    top = F.transform(F.sort_array(F.collect_list(F.struct("rn", "token"))), lambda x: x["token"].cast("string"))
    return counts.groupBy("piece_id").agg(F.array_join(top, " ").alias("top"))


SOURCE_SQL = "CASE " + " ".join(f"WHEN contains('/' || lower(path) || '/', '/{s}/') THEN '{s}'" for s in ("musetrainer", "symbtr", "asap", "pdmx")) + " WHEN regexp_matches(lower(path), '(^|/)external/[^/]+') THEN regexp_extract(lower(path), '(?:^|/)external/([^/]+)', 1) ELSE 'unknown' END"


@C.add("stx11_source_labels", REC + f"SELECT {SOURCE_SQL} AS source, count(*) AS n FROM records WHERE path IS NOT NULL GROUP BY 1")
def stx11(spark, d):
    return records(spark, d).where("path is not null").groupBy(X.source_label(F.col("path")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@C.add("stx12_devices", "SELECT DISTINCT model, CASE WHEN regexp_matches(lower(model), 'transformer|cuda|gpu') THEN 'gpu' ELSE 'cpu' END AS device FROM piece_metrics WHERE model IS NOT NULL")
def stx12(spark, d):
    named = F.when(F.lower("model").contains("transformer"), F.lit("cuda:0")).otherwise(F.col("model"))
    return table(spark, d, "piece_metrics").where("model is not null").select("model", X.device_class(named).alias("device")).distinct()


@C.add("stx13_booleans", "SELECT contains_rests, count(*) AS n FROM (SELECT metadata.contains_rests AS contains_rests FROM prepared_pieces) GROUP BY 1")
def stx13(spark, d):
    """Booleans written as words and read again."""
    written = F.when(F.col("metadata.contains_rests"), " Yes").when(~F.col("metadata.contains_rests"), "0")
    return table(spark, d, "prepared_pieces").select(X.truth(written).alias("contains_rests")).groupBy("contains_rests").agg(F.count(F.lit(1)).alias("n"))


@C.add("stx14_redacted_paths", REC + r"""SELECT piece_id, regexp_replace(regexp_replace('see ' || path || ' at https://host' || path || ' or C:\data\' || piece_id || ', not ' || piece_id,
  '(^|[^\w:/.])((/[\w.~-]+){2,}/?)', '\1<path>', 'g'), '(^|\W)[A-Za-z]:\\[^\s"'']+', '\1<path>', 'g') AS message FROM records WHERE path IS NOT NULL""")
def stx14(spark, d):
    message = F.concat(F.lit("see "), "path", F.lit(" at https://host"), "path", F.lit(" or C:\\data\\"), "piece_id", F.lit(", not "), "piece_id")
    return records(spark, d).where("path is not null").select("piece_id", X.redacted_paths(message).alias("message"))


STEPS = ("", "../", "a/../", "/", "C:", "a//", "..")


@C.add("stx15_safe_paths", REC + r"""SELECT step, count(*) AS n, CAST(sum(CASE WHEN p = '' OR starts_with(p, '/') OR starts_with(p, '\') OR contains(p, '\') OR contains(p, '//') OR p[2] = ':' OR list_contains(string_split(p, '/'), '..') THEN 0 ELSE 1 END) AS BIGINT) AS n_safe
  FROM (SELECT step, step || piece_id AS p FROM records CROSS JOIN (SELECT unnest(['', '../', 'a/../', '/', 'C:', 'a//', '..']) AS step)) GROUP BY 1""")
def stx15(spark, d):
    """Ids of pieces as relative paths, and with what makes a path unsafe or not put in front."""
    rows = records(spark, d).select("piece_id", F.explode(F.array(*[F.lit(x) for x in STEPS])).alias("step"))
    return rows.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.safe_relative(F.concat("step", "piece_id"))).alias("n_safe"))


@C.add("stx16_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def stx16(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@C.add("stx17_fragments", REC + "SELECT w.fragment, bool_or(contains(lower(title), w.fragment)) AS found FROM records CROSS JOIN (VALUES ('nocturne'), ('carousel'), ('absent word')) w(fragment) WHERE title IS NOT NULL GROUP BY 1")
def stx17(spark, d):
    """Whether any title contains a fragment."""
    hits = records(spark, d).where("title is not null").agg(*[F.bool_or(F.contains(F.lower("title"), F.lit(w))).alias(w) for w in ("nocturne", "carousel", "absent word")])
    return hits.unpivot([], ["nocturne", "carousel", "absent word"], "fragment", "found")


@C.add("stx18_number_lists", TOK + ", s AS (SELECT piece_id, count(*) AS n, sum(token) AS total FROM tok WHERE t < 8 GROUP BY 1) SELECT piece_id, CAST(n AS INTEGER) AS n, CAST(total AS BIGINT) AS total FROM s")
def stx18(spark, d):
    """Lists typed with commas, blanks between, read as numbers; the first eight tokens, as in its SQL."""
    return typed_lists(pieces(spark, d).withColumn("tokens", F.slice("tokens", 1, 8)))


@C.add("stx18_number_lists_whole")
def stx18_whole(spark, d):
    """The same over every token of each piece."""
    return typed_lists(pieces(spark, d))


def typed_lists(rows):
    numbers = X.number_list(F.concat(F.array_join("tokens", " , "), F.lit(", ,")))
    return rows.where(F.size("tokens") > 0).select("piece_id", F.size(numbers).alias("n"), F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@C.add("stx19_short_names", REC + "SELECT piece_id, left(title, 31) AS sheet FROM records WHERE title IS NOT NULL")
def stx19(spark, d):
    return records(spark, d).where("title is not null").select("piece_id", F.left("title", F.lit(31)).alias("sheet"))


@C.add("src02_relative_ids", REC + "SELECT piece_id, replace(path, '/data/external/', '') AS relative_id, replace(path, '/data/external/', '') = piece_id AS same FROM records WHERE path IS NOT NULL")
def src02(spark, d):
    relative = F.regexp_replace("path", "^/data/external/", "")
    return records(spark, d).where("path is not null").select("piece_id", relative.alias("relative_id"), (relative == F.col("piece_id")).alias("same"))


@C.add("src06_filename_fields", "WITH s AS (SELECT DISTINCT piece_id, string_split(replace(regexp_replace(regexp_extract(piece_id, '([^/]*)$', 1), '\\.mxl$', ''), '_', '--'), '--') AS p FROM score_records) SELECT piece_id, p[1] AS form, p[2] AS number, coalesce(nullif(p[3], ''), 'unknown') AS usul FROM s")
def src06(spark, d):
    """Fields parted by double hyphens in a file name, missing ones unknown."""
    ids = table(spark, d, "score_records").select("piece_id").distinct()
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract("piece_id", "([^/]*)$", 1), r"\.mxl$", ""), "_", "--")
    return filename_fields(ids.withColumn("name", name), "name", ["form", "number", "usul"], {"usul": "unknown"}).select("piece_id", "form", "number", "usul")


@C.add("agg01_catalog_counts", REC + f"SELECT {rule_sql(PLAIN_SQL, X.FORMS, 'piece')} AS form, split_part(piece_id, '/', 1) AS source, count(*) AS n FROM records WHERE title IS NOT NULL GROUP BY 1, 2")
def agg01(spark, d):
    return records(spark, d).where("title is not null").groupBy(X.form(F.col("title")).alias("form"), F.substring_index("piece_id", "/", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@C.add("agg06_top_labels", REC + """, c AS (SELECT split_part(piece_id, '/', 1) AS source, composer, count(*) AS n, min(piece_id) AS first FROM records WHERE composer IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rn FROM c)
  SELECT source, array_to_string(list(composer || ' (' || n || ')' ORDER BY rn), ', ') AS top FROM r WHERE rn <= 3 GROUP BY 1""")
def agg06(spark, d):
    """The commonest labels of each group, the first seen of equals."""
    counts = records(spark, d).where("composer is not null").groupBy(F.substring_index("piece_id", "/", 1).alias("source"), "composer").agg(F.count(F.lit(1)).alias("n"), F.min("piece_id").alias("first"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "first"))).where("rn <= 3")
    text = F.transform(F.sort_array(F.collect_list(F.struct("rn", F.concat("composer", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("s")))), lambda x: x["s"])
    return ranked.groupBy("source").agg(F.array_join(text, ", ").alias("top"))


@C.add("agg32_token_rarity", TOK + """, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), s AS (SELECT list_sort(list(n)) AS a, count(*) AS m FROM c)
  SELECT token, n, CASE WHEN n <= a[1 + greatest(m // 3 - 1, 0)] THEN 'rare' WHEN n <= a[1 + greatest(2 * m // 3 - 1, 0)] THEN 'medium' ELSE 'common' END AS rarity FROM c CROSS JOIN s""")
def agg32(spark, d):
    counts = tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    cuts = R.order_statistics(counts, "n", {"lo": lambda m: F.greatest(F.floor(m / 3) - 1, F.lit(0)), "hi": lambda m: F.greatest(F.floor(2 * m / 3) - 1, F.lit(0))})
    rarity = F.when(F.col("n") <= F.col("lo"), "rare").when(F.col("n") <= F.col("hi"), "medium").otherwise("common")
    return counts.join(F.broadcast(cuts)).select("token", "n", rarity.alias("rarity"))


@C.add("agg34_preparation_report", f"WITH {PIECES_SQL}, x AS (SELECT DISTINCT piece_id, reason FROM exclusion_records) SELECT (SELECT count(*) FROM pieces) AS n_prepared, (SELECT count(*) FROM x) AS n_excluded, (SELECT CAST(sum(len(tokens)) AS BIGINT) FROM pieces) AS n_tokens")
def agg34(spark, d):
    p = pieces(spark, d).agg(F.count(F.lit(1)).alias("n_prepared"), F.sum(F.size("tokens").cast("bigint")).alias("n_tokens"))
    x = table(spark, d, "exclusion_records").select("piece_id", "reason").distinct().agg(F.count(F.lit(1)).alias("n_excluded"))
    return p.crossJoin(x).select("n_prepared", "n_excluded", "n_tokens")  # one row each


@C.add("agg42_split_payload", f"WITH {PIECES_SQL}, {RECORDS_SQL} SELECT r.split, count(*) AS n_pieces, count(DISTINCT nullif(lower(trim(p.canonical_work_id)), '')) AS n_groups, CAST(sum(len(p.tokens)) AS BIGINT) AS n_tokens FROM pieces p JOIN records r USING (piece_id) WHERE r.split IS NOT NULL GROUP BY 1")
def agg42(spark, d):
    s = records(spark, d).where("split is not null").select("piece_id", "split")
    return pieces(spark, d).join(s, "piece_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.countDistinct(F.nullif(F.lower(F.trim("canonical_work_id")), F.lit(""))).alias("n_groups"), F.sum(F.size("tokens").cast("bigint")).alias("n_tokens")
    )


@C.add("agg43_absorbed_texts", "WITH c AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS absorbed, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_grouped FROM c")
def agg43(spark, d):
    """Texts absorbed by exact copies; grouped by digest, so whole texts are not shuffled."""
    c = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") - 1).alias("absorbed"), F.count_if(F.col("n") > 1).alias("n_grouped"))


@C.add("agg20_contingency", REC + "SELECT split_part(piece_id, '/', 1) AS a, split AS b, count(*) AS n FROM records WHERE split IS NOT NULL GROUP BY 1, 2")
def agg20(spark, d):
    return contingency(records(spark, d).withColumn("source", F.substring_index("piece_id", "/", 1)), "source", "split")


AGREE_SQL = REC + """, c AS (SELECT split_part(piece_id, '/', 1) AS a, split AS b, count(*) AS n FROM records WHERE split IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
  r AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1),
  mi AS (SELECT sum(n / t * ln(n * t / (ra * cb))) AS mi, sum(n * (n - 1) / 2) AS idx FROM c JOIN r USING (a) JOIN k USING (b) CROSS JOIN t),
  ha AS (SELECT sum(-ra / t * ln(ra / t)) AS h, sum(ra * (ra - 1) / 2) AS p FROM r CROSS JOIN t), hb AS (SELECT sum(-cb / t * ln(cb / t)) AS h, sum(cb * (cb - 1) / 2) AS p FROM k CROSS JOIN t)"""


@C.add("agg21_agreement", AGREE_SQL + " SELECT CAST(t AS BIGINT) AS n, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi, round((idx - ha.p * hb.p / (t * (t - 1) / 2)) / ((ha.p + hb.p) / 2 - ha.p * hb.p / (t * (t - 1) / 2)), 6) AS ari FROM mi CROSS JOIN ha CROSS JOIN hb CROSS JOIN t")
def agg21(spark, d):
    """NMI and ARI of source against split."""
    return agreement(records(spark, d).withColumn("source", F.substring_index("piece_id", "/", 1)), "source", "split")


@C.add("jon01_metrics_of_pieces", f"WITH {METRICS_SQL}, {PIECES_SQL} SELECT m.model, count(*) AS n, count(DISTINCT m.piece_id) AS n_pieces, CAST(sum(len(p.tokens)) AS BIGINT) AS n_tokens FROM metrics m JOIN pieces p USING (piece_id) WHERE m.model IS NOT NULL GROUP BY 1")
def jon01(spark, d):
    n = pieces(spark, d).select("piece_id", F.size("tokens").cast("bigint").alias("n"))
    return metrics(spark, d).where("model is not null").join(n, "piece_id").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece_id").alias("n_pieces"), F.sum("n").alias("n_tokens"))


@C.add("jon01_unknown_pieces", f"WITH {METRICS_SQL} SELECT DISTINCT piece_id FROM metrics WHERE piece_id NOT IN (SELECT piece_id FROM prepared_pieces WHERE piece_id IS NOT NULL)")
def jon01b(spark, d):
    """Scored pieces that don't exist: the referential check."""
    return metrics(spark, d).where("piece_id is not null").select("piece_id").distinct().join(table(spark, d, "prepared_pieces").select("piece_id"), "piece_id", "left_anti")


@C.add("jon02_split_of_pieces", f"WITH {PIECES_SQL}, {RECORDS_SQL} SELECT piece_id, r.split FROM pieces JOIN records r USING (piece_id)")
def jon02(spark, d):
    return pieces(spark, d).select("piece_id").join(records(spark, d).select("piece_id", "split"), "piece_id")


@C.add("jon05_pending", "SELECT DISTINCT piece_id FROM musical_events WHERE piece_id NOT IN (SELECT piece_id FROM prepared_pieces WHERE piece_id IS NOT NULL) AND piece_id NOT IN (SELECT piece_id FROM exclusion_records WHERE piece_id IS NOT NULL)")
def jon05(spark, d):
    """Pieces with events that were neither prepared nor excluded."""
    done = table(spark, d, "prepared_pieces").select("piece_id").union(table(spark, d, "exclusion_records").select("piece_id"))
    return table(spark, d, "musical_events").select("piece_id").distinct().join(done, "piece_id", "left_anti")


@C.add("jon05_cached", "SELECT DISTINCT piece_id FROM prepared_pieces WHERE piece_id IN (SELECT piece_id FROM score_records)")
def jon05b(spark, d):
    return table(spark, d, "prepared_pieces").select("piece_id").distinct().join(table(spark, d, "score_records"), "piece_id", "left_semi")


PERIOD_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in X.PERIODS.items())


@C.add("jon13_period_default", REC + f", t AS (SELECT {rule_sql(PLAIN_SQL, X.COMPOSERS, 'Unknown')} AS c FROM records WHERE title IS NOT NULL) SELECT coalesce(p.period, 'unknown') AS period, count(*) AS n FROM t LEFT JOIN (VALUES {PERIOD_VALUES}) p(c, period) USING (c) GROUP BY 1")
def jon13(spark, d):
    """Period of the composer told by a title, with a default."""
    periods = F.broadcast(spark.createDataFrame(list(X.PERIODS.items()), "c string, period string"))  # a fixed table
    told = records(spark, d).where("title is not null").select(X.first_match(X.plain(F.col("title")), X.COMPOSERS, "Unknown").alias("c"))
    return told.join(periods, "c", "left").groupBy(F.coalesce("period", F.lit("unknown")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@C.add("jon16_candidate_paths", """WITH c AS (SELECT DISTINCT piece_id, path, k, CASE k WHEN 1 THEN path WHEN 2 THEN '/data/external/' || piece_id ELSE replace(path, '.mxl', '.xml') END AS candidate FROM score_records CROSS JOIN range(1, 4) r(k) WHERE path IS NOT NULL)
  SELECT piece_id, arg_min(candidate, k) AS resolved FROM c WHERE candidate IN (SELECT source_path FROM prepared_pieces) GROUP BY 1""")
def jon16(spark, d):
    """The first of a record's possible paths that exists."""
    rows = table(spark, d, "score_records").where("path is not null").select("piece_id", "path").distinct()
    options = [F.col("path"), F.concat(F.lit("/data/external/"), "piece_id"), F.regexp_replace("path", r"\.mxl", ".xml")]
    return resolve_paths(rows, "piece_id", options, table(spark, d, "prepared_pieces").select(F.col("source_path").alias("path")))


@C.add("prj08_no_detail", "SELECT reason, count(*) AS n FROM (SELECT DISTINCT piece_id, reason, detail FROM exclusion_records) WHERE coalesce(trim(detail), '') = '' GROUP BY 1")
def prj08(spark, d):
    rows = table(spark, d, "exclusion_records").select("piece_id", "reason", "detail").distinct()
    return rows.where(F.coalesce(F.trim("detail"), F.lit("")) == "").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@C.add("prj09_tolerant_select", "SELECT DISTINCT piece_id, title, composer FROM score_records")
def prj09(spark, d):
    """Of the columns asked for, those that exist."""
    rows = table(spark, d, "score_records")
    wanted = ["piece_id", "title", "composer", "genre", "license"]
    return rows.select(*[c for c in wanted if c in rows.columns]).distinct()


@C.add("prj10_flag_subset", "SELECT count(*) AS n FROM prepared_pieces WHERE coalesce(metadata.contains_rests, false)")
def prj10(spark, d):
    return table(spark, d, "prepared_pieces").where(F.coalesce(F.col("metadata.contains_rests"), F.lit(False))).agg(F.count(F.lit(1)).alias("n"))


@C.add("prj11_last_non_blank", f"WITH {PIECES_SQL}, {RECORDS_SQL} SELECT piece_id, coalesce(nullif(trim(p.title), ''), nullif(trim(r.title), ''), piece_id) AS title FROM pieces p LEFT JOIN records r USING (piece_id)")
def prj11(spark, d):
    """The first title that is not blank, in order of trust."""
    own = pieces(spark, d).select("piece_id", F.col("title").alias("p"))
    other = records(spark, d).select("piece_id", F.col("title").alias("r"))
    blank = F.lit("")
    return own.join(other, "piece_id", "left").select("piece_id", F.coalesce(F.nullif(F.trim("p"), blank), F.nullif(F.trim("r"), blank), F.col("piece_id")).alias("title"))


@C.add("prj14_alias_precedence", "SELECT CAST(sum(CASE WHEN n_tokens IS NOT NULL THEN n_tokens ELSE n_events END) AS BIGINT) AS tokens_first, CAST(sum(coalesce(n_events, n_tokens)) AS BIGINT) AS events_first FROM score_records")
def prj14(spark, d):
    rows = table(spark, d, "score_records")
    return rows.agg(F.sum(F.coalesce("n_tokens", "n_events")).alias("tokens_first"), F.sum(F.coalesce("n_events", "n_tokens")).alias("events_first"))


@C.add("prj24_length_buckets", PCS + "SELECT piece_id, CAST(len(tokens) AS INTEGER) AS n_tokens, CASE WHEN len(tokens) < 64 THEN 'short' WHEN len(tokens) < 192 THEN 'medium' WHEN len(tokens) < 512 THEN 'long' ELSE 'very_long' END AS bucket FROM pieces")
def prj24(spark, d):
    n = F.size("tokens")
    return pieces(spark, d).select("piece_id", n.alias("n_tokens"), F.when(n < 64, "short").when(n < 192, "medium").when(n < 512, "long").otherwise("very_long").alias("bucket"))


@C.add("win13_representatives", f"WITH {PIECES_SQL}, k AS (SELECT piece_id, nullif(lower(trim(regexp_replace(canonical_work_id, '[\\s_.\\-]+', ' ', 'g'))), '') AS work FROM pieces) SELECT work, min(piece_id) AS piece_id FROM k WHERE work IS NOT NULL GROUP BY 1")
def win13(spark, d):
    """The first piece of each work; a map-side combined minimum, so a hot work costs no more."""
    work = F.trim(F.lower(F.regexp_replace("canonical_work_id", r"[\s_.\-]+", " ")))
    return pieces(spark, d).select(work.alias("work"), "piece_id").where("work <> ''").groupBy("work").agg(F.min("piece_id").alias("piece_id"))


@C.add("win16_nested_fractions", f"WITH {RECORDS_SQL}, k AS (SELECT DISTINCT split_part(piece_id, '/', 1) AS source, piece_id FROM records WHERE split = 'train'), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || piece_id), piece_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM k) SELECT source, piece_id, CAST(frac AS DOUBLE) AS frac FROM r CROSS JOIN (VALUES (0.1), (0.25), (0.5), (1.0)) f(frac) WHERE p <= greatest(1, least(n, round_even(frac * n, 0)))")
def win16(spark, d):
    train = records(spark, d).where("split = 'train'").select(F.substring_index("piece_id", "/", 1).alias("source"), "piece_id")
    return R.nested_fractions(train, "source", "piece_id", [0.1, 0.25, 0.5, 1.0], 5)


@C.add("srt01_sorted", REC + "SELECT piece_id, title, CAST(row_number() OVER (PARTITION BY split_part(piece_id, '/', 1) ORDER BY n_tokens DESC NULLS LAST, title ASC NULLS LAST, piece_id) AS INTEGER) AS place FROM records")
def srt01(spark, d):
    by = Window.partitionBy(F.substring_index("piece_id", "/", 1)).orderBy(F.desc_nulls_last("n_tokens"), F.asc_nulls_last("title"), "piece_id")
    return records(spark, d).select("piece_id", "title", F.row_number().over(by).alias("place"))


@C.add("srt03_longest", PCS + "SELECT piece_id, CAST(len(tokens) AS INTEGER) AS n FROM pieces ORDER BY n DESC, piece_id LIMIT 15")
def srt03(spark, d):
    """The fifteen longest pieces: a top-k report."""
    return pieces(spark, d).select("piece_id", F.size("tokens").alias("n")).orderBy(F.desc("n"), "piece_id").limit(15)


@C.add("srt05_seeded_sample", "SELECT piece_id FROM (SELECT DISTINCT piece_id FROM prepared_pieces WHERE piece_id IS NOT NULL) ORDER BY md5('3:' || piece_id), piece_id LIMIT 40")
def srt05(spark, d):
    """A sample of forty pieces without replacement."""
    return R.seeded_sample(table(spark, d, "prepared_pieces").where("piece_id is not null").select("piece_id").distinct(), "piece_id", 40, 3)


@C.add("srt06_hash_order", "SELECT DISTINCT piece_id, md5('3:' || piece_id) AS place FROM prepared_pieces WHERE piece_id IS NOT NULL")
def srt06(spark, d):
    return table(spark, d, "prepared_pieces").where("piece_id is not null").select("piece_id", R.hash_order(3, "piece_id").alias("place")).distinct()


@C.add("srt07_stratified_split", PCS + """, k AS (SELECT piece_id, split_part(piece_id, '/', 1) AS source, CASE WHEN len(tokens) < 64 THEN 'short' WHEN len(tokens) < 192 THEN 'medium' ELSE 'long' END AS bucket FROM pieces),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY md5('9:' || piece_id), piece_id) AS p, count(*) OVER (PARTITION BY source, bucket) AS n FROM k),
  a AS (SELECT *, CAST(round_even(n * 0.15, 0) AS INTEGER) AS nt FROM r), b AS (SELECT *, n - nt AS l FROM a), c AS (SELECT *, least(l, CAST(round_even(l * (0.1 / 0.85), 0) AS INTEGER)) AS v0 FROM b),
  e AS (SELECT *, CASE WHEN l >= 3 AND v0 = 0 THEN 1 ELSE v0 END AS v1 FROM c), f AS (SELECT *, CASE WHEN n >= 4 AND nt = 0 AND v1 >= l THEN greatest(0, l - 1) ELSE v1 END AS v, CASE WHEN n >= 4 AND nt = 0 THEN 1 ELSE nt END AS t FROM e)
  SELECT piece_id, source, bucket, CASE WHEN p <= t THEN 'test' WHEN p <= t + v THEN 'validation' ELSE 'train' END AS split FROM f""")
def srt07(spark, d):
    n = F.size("tokens")
    rows = pieces(spark, d).select("piece_id", F.substring_index("piece_id", "/", 1).alias("source"), F.when(n < 64, "short").when(n < 192, "medium").otherwise("long").alias("bucket"))
    return R.stratified_split(rows, ["source", "bucket"], "piece_id", 0.15, 0.1, 9)


@C.add("srt09_ratio_counts", REC + """, s AS (SELECT split_part(piece_id, '/', 1) AS source, CAST(count(*) AS INTEGER) AS n FROM records GROUP BY 1),
  f AS (SELECT *, greatest(CAST(floor(n * 0.8 + 1e-9) AS INTEGER), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS a, greatest(CAST(floor(n * 0.1 + 1e-9) AS INTEGER), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS b,
    round(n * 0.8 - floor(n * 0.8 + 1e-9), 9) AS ra, round(n * 0.1 - floor(n * 0.1 + 1e-9), 9) AS rb FROM s), g AS (SELECT *, n - a - b - b AS rest FROM f)
  SELECT source, n, CAST(a + CASE WHEN (CASE WHEN rb > ra THEN 2 ELSE 0 END) < rest THEN 1 ELSE 0 END AS INTEGER) AS train, CAST(b + CASE WHEN (CASE WHEN ra >= rb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS INTEGER) AS validation,
    CAST(b + CASE WHEN (CASE WHEN ra >= rb THEN 1 ELSE 0 END) + 1 < rest THEN 1 ELSE 0 END AS INTEGER) AS test FROM g""")
def srt09(spark, d):
    """Sizes of three splits of each source by floors and largest remainders."""
    s = records(spark, d).groupBy(F.substring_index("piece_id", "/", 1).alias("source")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    parts = R.ratio_counts(F.col("n"), {"train": 0.8, "validation": 0.1, "test": 0.1})
    return s.select("source", "n", *[c.cast("int").alias(k) for k, c in parts.items()])


@C.add("srt08_group_split", f"""WITH {PIECES_SQL}, k AS (SELECT piece_id, coalesce(nullif(lower(trim(regexp_replace(canonical_work_id, '[\\s_.\\-]+', ' ', 'g'))), ''), piece_id) AS work FROM pieces),
  g AS (SELECT DISTINCT work FROM k), r AS (SELECT work, CAST(('0x' || substr(md5('4:' || work), 1, 8)) AS BIGINT) % 100 AS h FROM g)
  SELECT piece_id, work, CASE WHEN h < 10 THEN 'test' WHEN h < 20 THEN 'validation' ELSE 'train' END AS split FROM k JOIN r USING (work)""")
def srt08(spark, d):
    """Works are split by their hash and the split is expanded to their pieces: no shuffle at all."""
    work = F.coalesce(F.nullif(F.trim(F.lower(F.regexp_replace("canonical_work_id", r"[\s_.\-]+", " "))), F.lit("")), F.col("piece_id"))
    h = F.pmod(F.conv(F.substring(R.hash_order(4, "work"), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    rows = pieces(spark, d).select("piece_id", work.alias("work"))
    return rows.withColumn("split", F.when(h < 10, "test").when(h < 20, "validation").otherwise("train"))


@C.add("srt11_window_cap", PCS + ", n AS (SELECT piece_id, len(tokens) AS n FROM pieces), s AS (SELECT piece_id, n, unnest(range(0, n, 64)) AS start FROM n) SELECT piece_id, CAST(start AS INTEGER) AS start, CAST(least(start + 128, n) AS INTEGER) AS stop FROM s WHERE (start = 0 OR start - 64 + 128 < n) AND least(start + 128, n) - start >= 32 ORDER BY piece_id, start LIMIT 100")
def srt11(spark, d):
    """Training windows up to a cap, in order of piece and start: the cap is the feature."""
    return train_windows(pieces(spark, d).select("piece_id", F.size("tokens").alias("n"))).select("piece_id", "start", "stop").orderBy("piece_id", "start").limit(100)


@C.add("set01_union_all", "SELECT piece_id, title, reason FROM (SELECT piece_id, title, NULL AS reason FROM score_records UNION ALL SELECT piece_id, NULL, reason FROM exclusion_records)")
def set01(spark, d):
    a, b = table(spark, d, "score_records").select("piece_id", "title"), table(spark, d, "exclusion_records").select("piece_id", "reason")
    return a.unionByName(b, allowMissingColumns=True)


@C.add("set02_union", "SELECT piece_id FROM score_records UNION SELECT piece_id FROM exclusion_records")
def set02(spark, d):
    return table(spark, d, "score_records").select("piece_id").union(table(spark, d, "exclusion_records").select("piece_id")).distinct()


@C.add("set03_intersect", "SELECT piece_id FROM score_records INTERSECT SELECT piece_id FROM prepared_pieces")
def set03(spark, d):
    return table(spark, d, "score_records").select("piece_id").intersect(table(spark, d, "prepared_pieces").select("piece_id"))


@C.add("set04_except", "SELECT piece_id FROM musical_events EXCEPT SELECT piece_id FROM prepared_pieces")
def set04(spark, d):
    return table(spark, d, "musical_events").select("piece_id").subtract(table(spark, d, "prepared_pieces").select("piece_id"))


@C.add("set05_subset", PCS + "SELECT piece_id, len(list_filter(list_distinct(list_transform(tokens, lambda x: x // 5)), lambda p: p NOT IN (0, 2, 4, 5, 7, 9, 11))) = 0 AS diatonic FROM pieces")
def set05(spark, d):
    """Whether a piece keeps to the seven natural notes."""
    classes = F.array_distinct(F.transform("tokens", lambda x: F.floor(x / 5).cast("int")))
    return pieces(spark, d).select("piece_id", (F.size(F.array_except(classes, F.array(*[F.lit(p) for p in (0, 2, 4, 5, 7, 9, 11)]))) == 0).alias("diatonic"))


@C.add("dq02_prepared_pieces", PCS + "SELECT count(*) AS n, CAST(sum(CASE WHEN len(tokens) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN list_min(tokens) < 0 OR list_max(tokens) >= len(vocabulary) THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, count(DISTINCT vocabulary) AS n_vocabularies, CAST(sum(CASE WHEN n_events <> len(tokens) THEN 1 ELSE 0 END) AS BIGINT) AS wrong_size FROM pieces")
def dq02(spark, d):
    p = pieces(spark, d)
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("tokens") == 0).alias("empty"), F.count_if((F.array_min("tokens") < 0) | (F.array_max("tokens") >= F.size("vocabulary"))).alias("out_of_range"),
        F.countDistinct(F.xxhash64("vocabulary")).alias("n_vocabularies"), F.count_if(F.col("n_events") != F.size("tokens")).alias("wrong_size"),
    )


@C.add("dq03_leakage", REC + ", k AS (SELECT nullif(lower(trim(regexp_replace(canonical_work_id, '[\\s_.\\-]+', ' ', 'g'))), '') AS work, split FROM records WHERE split IS NOT NULL) SELECT work, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM k WHERE work IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def dq03(spark, d):
    work = F.nullif(F.trim(F.lower(F.regexp_replace("canonical_work_id", r"[\s_.\-]+", " "))), F.lit(""))
    return Q.leakage(records(spark, d).select(work.alias("work"), "split"), "work", "split")


@C.add("dq04_coverage", f"""WITH {PIECES_SQL}, s AS (SELECT piece_id, index AS i FROM musical_events WHERE index IS NOT NULL), n AS (SELECT piece_id, len(tokens) AS n FROM pieces),
  c AS (SELECT n.piece_id, n.n, i, count(*) AS times FROM s JOIN n USING (piece_id) GROUP BY ALL), a AS (SELECT piece_id, sum(times - 1) AS dup, sum(CASE WHEN i < 0 OR i >= n THEN 1 ELSE 0 END) AS o, sum(CASE WHEN i >= 0 AND i < n THEN 1 ELSE 0 END) AS cov FROM c GROUP BY 1)
  SELECT piece_id, CAST(coalesce(dup, 0) AS BIGINT) AS duplicate, CAST(coalesce(o, 0) AS BIGINT) AS out_of_range, CAST(n - coalesce(cov, 0) AS BIGINT) AS omitted, coalesce(dup, 0) = 0 AND coalesce(o, 0) = 0 AND n = coalesce(cov, 0) AS ok FROM n LEFT JOIN a USING (piece_id)""")
def dq04(spark, d):
    """Each token of a piece has exactly one event: repeated rows, strays and gaps."""
    expected = pieces(spark, d).select("piece_id", F.size("tokens").alias("n"))
    return Q.coverage(expected, table(spark, d, "musical_events").where("index is not null").select("piece_id", F.col("index").alias("i")), "piece_id", "n", "i")


@C.add("dq05_work_ids", REC + "SELECT split_part(piece_id, '/', 1) AS source, CAST(sum(CASE WHEN canonical_work_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN trim(canonical_work_id) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank FROM records GROUP BY 1")
def dq05(spark, d):
    w = F.col("canonical_work_id")
    return records(spark, d).groupBy(F.substring_index("piece_id", "/", 1).alias("source")).agg(F.count_if(w.isNull()).alias("missing"), F.count_if(F.trim(w) == "").alias("blank"))


@C.add("dq08_work_groups", f"""WITH {PIECES_SQL}, l AS (SELECT piece_id, composer, nullif(lower(trim(regexp_replace(canonical_work_id, '[\\s_.\\-]+', ' ', 'g'))), '') AS work, tokens[1:33] AS h FROM pieces),
  f AS (SELECT *, CASE WHEN len(h) >= 2 THEN substr(sha256(array_to_string(list_transform(range(2, len(h) + 1), lambda i: CAST(h[i] - h[i - 1] AS VARCHAR)), ',')), 1, 16) END AS fp FROM l)
  SELECT work, count(*) AS n_files, count(DISTINCT fp) > 1 AS fingerprints_disagree, count(DISTINCT composer) > 1 AS multiple_composers FROM f WHERE work IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def dq08(spark, d):
    """Works of several files: do their tunes and composers agree."""
    work = F.nullif(F.trim(F.lower(F.regexp_replace("canonical_work_id", r"[\s_.\-]+", " "))), F.lit(""))
    rows = pieces(spark, d).select("composer", work.alias("work"), fingerprint(F.col("tokens")).alias("fp")).where("work is not null")
    return rows.groupBy("work").agg(F.count(F.lit(1)).alias("n_files"), (F.countDistinct("fp") > 1).alias("fingerprints_disagree"), (F.countDistinct("composer") > 1).alias("multiple_composers")).where("n_files > 1")


@C.add("dq08_near_miss_keys", REC + f", k AS (SELECT {CANON_SQL.format(x='title')} AS work, {KEY_SQL} AS key FROM records WHERE title IS NOT NULL) SELECT key, count(DISTINCT work) AS n_works FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT work) > 1")
def dq08b(spark, d):
    """Titles that differ in punctuation, blanks and accents alone."""
    fold = F.translate("work", "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
    rows = records(spark, d).where("title is not null").select(Q.canonical_work(F.col("title")).alias("work"))
    keys = rows.withColumn("key", F.regexp_replace(fold, "[^a-z0-9]+", ""))
    return keys.where("key <> ''").groupBy("key").agg(F.countDistinct("work").alias("n_works")).where("n_works > 1")


@C.add("dq10_annotations", f"WITH {EVENTS_SQL}, a AS (SELECT piece_id, t AS event_index, measure AS segment_label FROM ev WHERE measure IS NOT NULL) SELECT count(*) AS n, CAST(sum(CASE WHEN event_index < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, count(*) - count(DISTINCT (piece_id, event_index)) AS repeated FROM a")
def dq10(spark, d):
    """Structural annotations: indices not negative, coordinates unique."""
    a = events(spark, d).where("measure is not null").select("piece_id", F.col("t").alias("event_index"))
    per = a.groupBy("piece_id", "event_index").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("event_index") < 0, F.col("k")).otherwise(0)).alias("negative"), (F.sum("k") - F.count(F.lit(1))).alias("repeated"))


@C.add("agg35_worst_status", "WITH s AS (SELECT reason, CASE WHEN detail IS NULL THEN 'missing' WHEN trim(detail) = '' THEN 'partial' ELSE 'ok' END AS status FROM exclusion_records) SELECT reason, CASE max(CASE status WHEN 'ok' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' ELSE 'missing' END AS worst, CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok FROM s GROUP BY 1")
def agg35(spark, d):
    """The worst status of each group, by rank."""
    status = F.when(F.col("detail").isNull(), "missing").when(F.trim("detail") == "", "partial").otherwise("ok")
    rank = F.array_position(F.array(F.lit("ok"), F.lit("partial"), F.lit("missing")), F.col("status"))
    rows = table(spark, d, "exclusion_records").select("reason", status.alias("status"))
    return rows.groupBy("reason").agg(F.max_by("status", rank).alias("worst"), F.count_if(F.col("status") == "ok").alias("n_ok"))


@C.add("fig01_catalog_figures", REC + "SELECT 'source' AS figure, split_part(piece_id, '/', 1) AS label, count(*) AS n FROM records GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM records WHERE split IS NOT NULL GROUP BY 2")
def fig01(spark, d):
    r = records(spark, d)
    a = r.groupBy(F.substring_index("piece_id", "/", 1).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("figure"), "label", "n")
    b = r.where("split is not null").groupBy(F.col("split").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("split").alias("figure"), "label", "n")
    return a.union(b)


@C.add("arr04_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def arr04(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@C.add("arr05_json_encode", f"WITH {METRICS_SQL} SELECT DISTINCT '{{\"model\":\"' || model || '\",\"seed\":' || data_seed || '}}' AS encoded FROM metrics WHERE model IS NOT NULL AND data_seed IS NOT NULL")
def arr05(spark, d):
    return metrics(spark, d).where("model is not null and data_seed is not null").select(F.to_json(F.struct("model", F.col("data_seed").alias("seed"))).alias("encoded")).distinct()


@C.add("arr08_cells", f"WITH {EVENTS_SQL} SELECT piece_id, t, '(' || array_to_string(midi_pitches, ', ') || ')' AS cell FROM ev")
def arr08(spark, d):
    return events(spark, d).select("piece_id", "t", F.concat(F.lit("("), F.array_join(F.col("midi_pitches").cast("array<string>"), ", "), F.lit(")")).alias("cell"))


@C.add("dat_valid_dates", "SELECT count(*) AS n, count(try_cast(strftime(registered_at, '%Y-%m-%d') AS DATE)) AS valid, min(CAST(registered_at AS DATE)) AS first_day FROM score_records")
def dat(spark, d):
    day = F.date_format("registered_at", "yyyy-MM-dd")
    return table(spark, d, "score_records").agg(F.count(F.lit(1)).alias("n"), F.count(F.try_to_date(day)).alias("valid"), F.min(F.to_date("registered_at")).alias("first_day"))
