"""Queries on manifests, duplicates, folds and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import duplicates as D
from ..operators import folds as K
from ..operators import graph as G
from ..operators import manifest as A
from ..operators import review as R
from ..operators import similarity as S
from ..operators import validate as V
from ..operators.metrics import METRIC_COLUMNS, metrics, rounded
from ..operators.persist import cut
from .evaluation import class_sql, metric_sql
from .fixtures import DECISIONS_SQL, HASHES_SQL, MANIFEST_SQL, PRED_SQL, decisions, hashes, manifest, pred, sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


@query("SELECT c_mktsegment AS filename, c_custkey AS row_id, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) = 1")
def manifest_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("filename"), F.col("c_custkey").alias("row_id"), "c_name")
    return A.last_of_key(rows, "filename", "row_id")


LATER_SQL = "later AS (SELECT filename, NOT (row_number() OVER (PARTITION BY sha256 ORDER BY frame_id NULLS LAST, relative_path) > 1) AS training_use FROM manifest WHERE split = 'train' AND label IS NOT NULL)"


@query(sql(MANIFEST_SQL, LATER_SQL, body="SELECT filename, training_use, CASE WHEN training_use THEN '' ELSE 'later_exact_duplicate' END AS training_exclusion_reason FROM later"))
def later_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.later_duplicates(manifest(spark, sf_dir))


@query(sql(MANIFEST_SQL, LATER_SQL, body="SELECT filename FROM later WHERE training_use"))
def train_index_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose training_use says true in any case, as the CSV has it."""
    text = F.when(F.col("training_use"), "True").otherwise("False")
    return A.later_duplicates(manifest(spark, sf_dir)).withColumn("training_use", text).filter(F.lower("training_use") == "true").select("filename")


@query(sql(MANIFEST_SQL, body="SELECT filename, relative_path, split, coalesce(label, 'unlabeled') AS label, CASE WHEN label IS NULL THEN 'unlabeled' ELSE 'unreviewed' END AS review_status, declared_width, declared_height FROM manifest"))
def manifest_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("label").isNull(), "unlabeled").otherwise("unreviewed")
    return manifest(spark, sf_dir).select("filename", "relative_path", "split", F.coalesce("label", F.lit("unlabeled")).alias("label"), status.alias("review_status"), "declared_width", "declared_height")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS number FROM documents")
def filename_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(n, F.lit(".jpg"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x"), n, F.lit(".jpg"))).otherwise(F.concat(n, F.lit(".a.jpg")))
    return table(spark, sf_dir, "documents").select("doc_id", names.filename_number(name).alias("number"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'train' ELSE 'unknown' END AS split FROM documents")
def infer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id") % 4
    path = F.when(at == 0, "a/train/x.jpg").when(at == 1, "val/b/x.jpg").when(at == 2, "test/train/x.jpg").otherwise("a/training/x.jpg")
    return table(spark, sf_dir, "documents").select("doc_id", names.infer_split(path).alias("split"))


@query(sql(MANIFEST_SQL, body="SELECT filename, coalesce(width <> declared_width OR height <> declared_height, false) AS size_mismatch FROM manifest"))
def size_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = (F.col("width") != F.col("declared_width")) | (F.col("height") != F.col("declared_height"))
    return manifest(spark, sf_dir).select("filename", F.coalesce(off, F.lit(False)).alias("size_mismatch"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 10 + 7 ELSE 1000000000000 END AS frame_key FROM documents")
def frame_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    frame = F.when(at == 0, F.concat(n, F.lit(".0"))).otherwise("")
    name = F.when(at == 2, "none.jpg").otherwise(F.concat(F.lit("cam_"), n, F.lit("_7.jpg")))
    return table(spark, sf_dir, "documents").select("doc_id", names.frame_key(frame, name).alias("frame_key"))


@query(sql(MANIFEST_SQL, body="SELECT filename FROM manifest WHERE split = 'train' AND coalesce(CASE doc_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN NULL ELSE 'yes' END, 'yes') = 'yes'"))
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    enabled = F.when(F.col("doc_id") % 5 == 0, "no").when(F.col("doc_id") % 5 != 1, "yes")
    return manifest(spark, sf_dir).filter((F.col("split") == "train") & (F.coalesce(enabled, F.lit("yes")) == "yes")).select("filename")


@query(sql(MANIFEST_SQL, body="SELECT filename, relative_path, '.png' AS extension, false AS jpg_only_scan, true AS all_supported_image_scan, 'extension' AS reason FROM manifest WHERE filename NOT LIKE '%.jpg'"))
def non_jpg_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    return manifest(spark, sf_dir).withColumn("extension", ext).filter("extension <> '.jpg'").select("filename", "relative_path", "extension", F.lit(False).alias("jpg_only_scan"), F.lit(True).alias("all_supported_image_scan"), F.lit("extension").alias("reason"))


GROUPS_SQL = "groups AS (SELECT sha256, count(*) AS n, min(relative_path) AS first_path FROM manifest GROUP BY 1 HAVING count(*) > 1)"
GROUP_TYPE_SQL = "CASE WHEN bool_and(split = 'train') THEN 'train_train' WHEN bool_and(split = 'test') THEN 'test_test' WHEN bool_and(split IN ('train', 'test')) THEN 'train_test' ELSE 'other_split' END"


@query(sql(MANIFEST_SQL, GROUPS_SQL, body="SELECT sha256, n, first_path, printf('dup_%04d', row_number() OVER (ORDER BY first_path) - 1) AS duplicate_group FROM groups"))
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_groups(manifest(spark, sf_dir))


@query(sql(MANIFEST_SQL, body=f"SELECT sha256, count(*) AS n, {GROUP_TYPE_SQL} AS group_type FROM manifest GROUP BY 1 HAVING count(*) > 1"))
def dup_group_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), A.group_type().alias("group_type")).filter("n > 1")


@query(sql(MANIFEST_SQL, body="SELECT sha256, relative_path, split FROM manifest WHERE sha256 IN (SELECT sha256 FROM manifest GROUP BY 1 HAVING count(DISTINCT split) > 1)"))
def dup_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups across splits, a row each."""
    rows = manifest(spark, sf_dir)
    across = rows.groupBy("sha256").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a < b").select("sha256")
    return rows.join(cut(across), "sha256").select("sha256", "relative_path", "split")


BLOCK_SQL = "blocks AS (SELECT doc_id, sum(new) OVER (ORDER BY doc_id) - 1 AS block FROM (SELECT doc_id, CASE WHEN doc_id - lag(doc_id) OVER (ORDER BY doc_id) > 1 OR lag(doc_id) OVER (ORDER BY doc_id) IS NULL THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc_id FROM labels)))"


@query(sql(BLOCK_SQL, body="SELECT doc_id, printf('file_block_%04d', block::BIGINT) AS sequence_id FROM blocks"))
def sequence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sequence_blocks(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "sequence_id")


@query(
    sql(
        MANIFEST_SQL, BLOCK_SQL, "x AS (SELECT m.split, coalesce(m.label, 'unlabeled') AS label, printf('file_block_%04d', block::BIGINT) AS sequence_id FROM manifest m JOIN blocks USING (doc_id))",
        "h AS (SELECT sequence_id, string_agg(label || ':' || n, ';' ORDER BY label) AS labels FROM (SELECT sequence_id, label, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1)",
        body="SELECT sequence_id, count(*) AS total_count, count(*) FILTER (WHERE split = 'train') AS train_count, count(*) FILTER (WHERE split = 'val') AS val_count, count(*) FILTER (WHERE split = 'test') AS test_count, any_value(labels) AS labels FROM x JOIN h USING (sequence_id) GROUP BY 1",
    )
)
def sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = A.sequence_blocks(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return A.sequence_summary(manifest(spark, sf_dir).join(blocks, "doc_id").select("split", "label", "sequence_id"))


@query(sql(MANIFEST_SQL, body="SELECT count(*) AS rows, count(label) AS labeled, count(*) - count(label) AS unlabeled, count(DISTINCT split) AS splits, count(DISTINCT sha256) AS distinct_digests, count(*) FILTER (WHERE frame_id IS NULL) AS without_frame, count(*) FILTER (WHERE width <> declared_width OR height <> declared_height) AS size_mismatches, count(*) FILTER (WHERE filename LIKE '%.png') AS png_files FROM manifest"))
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = (F.col("width") != F.col("declared_width")) | (F.col("height") != F.col("declared_height"))
    n = F.count(F.lit(1))
    return manifest(spark, sf_dir).agg(n.alias("rows"), F.count("label").alias("labeled"), (n - F.count("label")).alias("unlabeled"), F.countDistinct("split").alias("splits"), F.countDistinct("sha256").alias("distinct_digests"), F.count_if(F.col("frame_id").isNull()).alias("without_frame"), F.count_if(off).alias("size_mismatches"), F.count_if(F.col("filename").endswith(".png")).alias("png_files"))


@query(sql(MANIFEST_SQL, LATER_SQL, body="SELECT m.filename, m.relative_path, m.label, m.width, m.height, m.sha256, 'ok' AS decode_status, l.training_use AS enabled FROM manifest m JOIN later l USING (filename)"))
def train_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir)
    used = A.later_duplicates(rows).select("filename", F.col("training_use").alias("enabled"))
    return rows.join(used, "filename").select("filename", "relative_path", "label", "width", "height", "sha256", F.lit("ok").alias("decode_status"), "enabled")


@query(sql(MANIFEST_SQL, DECISIONS_SQL, body="SELECT filename, official_label, reviewed_label, review_status, 'passthrough_v1' AS label_version FROM decisions"))
def review_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("filename", "official_label", "reviewed_label", "review_status", F.lit("passthrough_v1").alias("label_version"))


@query(sql(MANIFEST_SQL, DECISIONS_SQL, body="SELECT 'passthrough_v1' AS label_version, count(*) AS records, count(reviewed_label) AS decisions, count(*) FILTER (WHERE reviewed_label <> label) AS not_applied, 0::BIGINT AS changed FROM manifest LEFT JOIN (SELECT filename, reviewed_label FROM decisions) USING (filename) WHERE label IS NOT NULL"))
def passthrough_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).filter("label is not null").select("filename", "label")
    return R.passthrough(rows, decisions(spark, sf_dir), "passthrough_v1")[1]


@query(sql(MANIFEST_SQL, DECISIONS_SQL, body="SELECT m.filename, coalesce(d.official_label, m.label) AS label FROM manifest m LEFT JOIN decisions d USING (filename) WHERE m.label IS NOT NULL"))
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).filter("label is not null").select("filename", "label")
    new = decisions(spark, sf_dir).select("filename", "official_label")
    return rows.join(new, "filename", "left").select("filename", F.coalesce("official_label", "label").alias("label"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'purchase', 'view')")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.outside_domain(table(spark, sf_dir, "events"), "event_type", ["click", "purchase", "view"]).select("event_id", "event_type")


@query("SELECT o_orderkey, position, expected FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN r + 1 ELSE r END AS position, r AS expected FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)) WHERE position <> expected")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored places that aren't those of the order; some are damaged here."""
    rows = A.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    rows = rows.withColumn("position", F.when(F.col("o_orderkey") % 1000 == 7, F.col("position") + 1).otherwise(F.col("position")))
    return V.out_of_order(rows, "position", "o_orderkey").select("o_orderkey", "position", "expected")


@query(sql(MANIFEST_SQL, DECISIONS_SQL, body="""SELECT filename, 'confirmed_changes' AS rule FROM decisions WHERE review_status = 'confirmed' AND reviewed_label <> official_label
UNION ALL SELECT filename, 'relabel_keeps' FROM decisions WHERE review_status = 'relabel' AND reviewed_label = official_label
UNION ALL SELECT filename, 'uncertain_changes' FROM decisions WHERE review_status = 'uncertain' AND reviewed_label <> official_label
UNION ALL SELECT filename, 'blank_notes' FROM decisions WHERE trim(review_notes) = ''"""))
def review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rule_violations(decisions(spark, sf_dir))


COPY_SQL = "m AS (SELECT o_orderkey AS filename, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderstatus AS label, o_orderpriority AS priority FROM orders), s AS (SELECT CASE WHEN position % 101 = 3 THEN filename + 1 ELSE filename END AS filename, position, CASE WHEN position % 53 = 5 THEN '?' ELSE label END AS label, priority FROM m WHERE position % 211 <> 9)"


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A list in order and a damaged copy of it."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filename"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("priority"))
    m = A.positions(rows, "filename")
    p = F.col("position")
    s = m.filter(p % 211 != 9).select(F.when(p % 101 == 3, F.col("filename") + 1).otherwise(F.col("filename")).alias("filename"), "position", F.when(p % 53 == 5, "?").otherwise(F.col("label")).alias("label"), "priority")
    return m, s


@query(sql(COPY_SQL, body="SELECT s.position, CASE WHEN s.filename <> m.filename THEN 'filename' WHEN s.label NOT IN ('F', 'O', 'P') THEN 'label' END AS problem FROM s JOIN m USING (position) WHERE s.filename <> m.filename OR s.label NOT IN ('F', 'O', 'P')"))
def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = _copies(spark, sf_dir)
    both = s.join(m.select("position", F.col("filename").alias("expected")), "position")
    problem = F.when(F.col("filename") != F.col("expected"), "filename").when(~F.col("label").isin("F", "O", "P"), "label")
    return both.select("position", problem.alias("problem")).filter("problem is not null")


@query(sql(COPY_SQL, body="SELECT position, concat_ws(',', CASE WHEN coalesce(m.filename::VARCHAR, '') <> coalesce(s.filename::VARCHAR, '') THEN 'filename' END, CASE WHEN coalesce(m.label, '') <> coalesce(s.label, '') THEN 'label' END, CASE WHEN coalesce(m.priority, '') <> coalesce(s.priority, '') THEN 'priority' END) AS differs FROM m FULL JOIN s USING (position) WHERE m.filename IS DISTINCT FROM s.filename OR m.label IS DISTINCT FROM s.label OR m.priority IS DISTINCT FROM s.priority"))
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = _copies(spark, sf_dir)
    return R.positional_diff(m, s, "position", ["filename", "label", "priority"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_size > 5) p ON l_partkey = p_partkey")
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return V.missing_parents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parent, "l_partkey")


@query(sql(MANIFEST_SQL, DECISIONS_SQL, body="SELECT d.filename, m.label, d.official_label FROM decisions d JOIN manifest m USING (filename) WHERE m.label <> d.official_label"))
def official_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).join(manifest(spark, sf_dir).select("filename", "label"), "filename").filter("label <> official_label").select("filename", "label", "official_label")


PAIRS_SQL = "pairs AS (SELECT a.id AS left_id, b.id AS right_id, b.frame - a.frame AS delta, bit_count(xor(a.hash, b.hash))::INT AS distance FROM hashes a JOIN hashes b ON a.dir = b.dir AND b.frame - a.frame BETWEEN 0 AND 10 AND a.id < b.id AND a.sha256 <> b.sha256 WHERE bit_count(xor(a.hash, b.hash)) <= 22)"


@query(sql(HASHES_SQL, PAIRS_SQL, body="SELECT left_id, right_id, delta, distance FROM pairs"))
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(hashes(spark, sf_dir), 10, 22)


COMPONENT_SQL = "edge AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs), reach AS (SELECT id AS a, id AS b FROM hashes UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"


def _pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(hashes(spark, sf_dir), 10, 22).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


@query(sql(HASHES_SQL, PAIRS_SQL, COMPONENT_SQL, body="SELECT id, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1)"))
def near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(_pair_edges(spark, sf_dir))


@query(sql(HASHES_SQL, PAIRS_SQL, COMPONENT_SQL, "k AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS i FROM (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1))", body="SELECT id, component, printf('near_%04d', i) AS group_id FROM comp JOIN k USING (component)"))
def component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.numbered(G.members(hashes(spark, sf_dir).select("id"), _pair_edges(spark, sf_dir)), "near_")


LINK_SQL = "link AS (SELECT doc_id AS a, first AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256) AS first FROM manifest) WHERE doc_id <> first UNION SELECT doc_id, doc_id - 1 FROM manifest WHERE doc_id % 9 = 4), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach AS (SELECT doc_id AS a, doc_id AS b FROM manifest UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = manifest(spark, sf_dir)
    exact = D.equal_digest_edges(rows, "doc_id", "sha256")
    near = rows.filter("doc_id % 9 = 4").select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"))
    return rows, exact.unionByName(near)


@query(sql(MANIFEST_SQL, LINK_SQL, body="SELECT id, component FROM comp"))
def dup_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of exact and neighbour links together."""
    rows, links = _links(spark, sf_dir)
    return G.members(rows.select(F.col("doc_id").alias("id")), links)


@query(sql(MANIFEST_SQL, LINK_SQL, body="SELECT component AS group_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id, bool_or(m.split = 'train') AND bool_or(m.split = 'test') AS leaks FROM comp JOIN manifest m ON m.doc_id = id GROUP BY 1 HAVING count(*) > 1"))
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = _links(spark, sf_dir)
    found = G.components(links).join(rows.select(F.col("doc_id").alias("id"), "split"), "id")
    has = lambda s: F.bool_or(F.col("split") == s)
    return found.groupBy(F.col("component").alias("group_id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), (has("train") & has("test")).alias("leaks"))


MERGE_SQL = "edge AS (SELECT DISTINCT 'g' || (a // 8) AS x, 'g' || (b // 8) AS y FROM link WHERE a % 3 <> 0), two AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge), grp AS (SELECT DISTINCT 'g' || (doc_id // 8) AS g FROM manifest), far AS (SELECT g AS x, g AS y FROM grp UNION SELECT f.x, t.y FROM far f JOIN two t ON f.y = t.x)"
LINK_ONLY_SQL = LINK_SQL.split(", both_ways")[0]


@query(sql(MANIFEST_SQL, LINK_ONLY_SQL, MERGE_SQL, body="SELECT x AS old_group, min(y) AS new_group FROM far GROUP BY 1"))
def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups merged by reviewed links between their members."""
    rows, links = _links(spark, sf_dir)
    group = lambda c: F.concat(F.lit("g"), F.floor(F.col(c) / 8).cast("string"))
    # links go from the later member; of those only reviewed ones count
    edges = links.filter("b % 3 <> 0").select(group("b").alias("a"), group("a").alias("b"))
    found = G.members(rows.select(group("doc_id").alias("id")).distinct(), edges)
    return found.select(F.col("id").alias("old_group"), F.col("component").alias("new_group"))


@query("SELECT user_id AS group_id, string_agg(event_type, '||' ORDER BY first) AS reasons FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def merge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_reasons(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").withColumnRenamed("user_id", "group_id")


@query(sql(HASHES_SQL, PAIRS_SQL, body="SELECT left_id, right_id, left_id % 4 AS left_fold, right_id % 4 AS right_fold FROM pairs WHERE left_id % 4 <> right_id % 4"))
def leak_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashes(spark, sf_dir)
    return D.leaking_pairs(D.near_pairs(rows, 10, 22), rows.select("id", (F.col("id") % 4).alias("fold")))


@query(sql(MANIFEST_SQL, body="SELECT sha256, string_agg(DISTINCT (doc_id % 4)::VARCHAR, ',' ORDER BY (doc_id % 4)::VARCHAR) AS folds FROM manifest GROUP BY 1 HAVING count(DISTINCT doc_id % 4) > 1"))
def leak_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.leaking_groups(manifest(spark, sf_dir).withColumn("fold", F.col("doc_id") % 4), "sha256")


@query(sql(MANIFEST_SQL, body="SELECT filename, row_number() OVER (ORDER BY frame_id NULLS LAST, relative_path) - 1 AS submission_order FROM manifest WHERE split = 'test'"))
def submission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).filter("split = 'test'").withColumn("key", F.coalesce("frame_id", F.lit(names.LAST_FRAME)))
    return A.positions(rows, "key", "relative_path", name="submission_order").select("filename", "submission_order")


@query(
    sql(
        MANIFEST_SQL, "c AS (SELECT label, count(*) AS n FROM manifest WHERE label IS NOT NULL GROUP BY 1)", "d AS (SELECT sha256, count(*) AS s FROM manifest GROUP BY 1)",
        "q AS (SELECT filename, m.label, n <= 60 AS few, concat_ws(';', CASE WHEN s > 1 THEN 'exact_duplicate' END, CASE WHEN n <= 60 THEN 'minority_class' END, CASE WHEN frame_id IS NULL THEN 'no_frame' END, CASE WHEN width <> declared_width OR height <> declared_height THEN 'size_mismatch' END) AS reasons FROM manifest m JOIN c USING (label) JOIN d USING (sha256))",
        body="SELECT filename, label, reasons, CASE WHEN few THEN 1 ELSE 2 END AS priority FROM q WHERE reasons <> ''",
    )
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.review_queue(manifest(spark, sf_dir)).orderBy("priority", "label", "filename")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 20")
def preview_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 unlabelled files: a preview of a report."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source").orderBy("doc_id").limit(20)


@query("SELECT doc_id, 'without_label' AS problem FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT l.doc_id, 'without_file' FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0) d USING (doc_id)")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").withColumn("problem", F.lit("without_label")).unionByName(labels.join(docs.filter("doc_id % 13 <> 0"), "doc_id", "left_anti").withColumn("problem", F.lit("without_file")))


_HELD = "list_transform(range(1, 5), lambda k: held[k][c] + CASE WHEN k = f THEN v[c] ELSE 0 END)"
_COST = f"round(list_sum(list_transform(range(1, 8), lambda c: sqrt(4 * list_sum(list_transform({_HELD}, lambda x: x * x)) - list_sum({_HELD}) * list_sum({_HELD})) / greatest(t[c], 1))), 12)"
DEAL_SQL = (
    f"c AS (SELECT [{', '.join(f'count(*) FILTER (WHERE true_id = {i})' for i in range(7))}] AS v FROM pred GROUP BY group_id)",
    f"tot AS (SELECT [{', '.join(f'sum(v[{i}])::BIGINT' for i in range(1, 8))}] AS t FROM c)",
    "s AS (SELECT v, list_transform(range(1, 8), lambda i: v[i] / greatest(t[i], 1)) AS s FROM c, tot)",
    "o AS (SELECT v, row_number() OVER (ORDER BY round(sqrt(list_sum(list_transform(s, lambda x: pow(x - list_sum(s) / 7, 2))) / 7), 9) DESC, v) AS i FROM s)",
    f"""deal AS (SELECT 0::BIGINT AS i, list_transform(range(4), lambda k: list_transform(range(7), lambda c: 0::BIGINT)) AS held
  UNION ALL SELECT i, list_transform(range(1, 5), lambda k: CASE WHEN k = best THEN list_transform(range(1, 8), lambda c: held[k][c] + v[c]) ELSE held[k] END) FROM (
    SELECT o.i, v, held, list_sort(list_transform(range(1, 5), lambda f: [{_COST}, list_sum(held[f])::DOUBLE, f::DOUBLE]))[1][3]::BIGINT AS best FROM deal JOIN o ON o.i = deal.i + 1, tot))""",
)


@query(sql(PRED_SQL, *DEAL_SQL, body="SELECT fold::INT AS fold, true_id::INT AS true_id, held[fold + 1][true_id + 1] AS n FROM (SELECT held FROM deal ORDER BY i DESC LIMIT 1), (SELECT unnest(range(4)) AS fold), (SELECT unnest(range(7)) AS true_id) WHERE held[fold + 1][true_id + 1] > 0"))
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and class counts of each fold; the SQL deals the groups one by one."""
    rows = pred(spark, sf_dir).select("group_id", "true_id")
    dealt = K.group_folds(rows, "group_id", "true_id", 7)
    return rows.join(dealt, "group_id").groupBy("fold", "true_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql(BLOCK_SQL, body="SELECT doc_id, 'sequence:' || printf('file_block_%04d', block::BIGINT) AS group_id FROM blocks"))
def seq_group_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = A.sequence_blocks(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return K.sequence_groups(blocks, "sequence_id", allow_provisional=True).select("doc_id", "group_id")


FOLDS_SQL = "folds AS (SELECT filename, doc_id % 4 AS fold FROM manifest WHERE doc_id % 17 <> 0)"


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).filter("doc_id % 17 <> 0").select("filename", (F.col("doc_id") % 4).alias("fold"))


@query(sql(MANIFEST_SQL, LATER_SQL, FOLDS_SQL, body="SELECT l.filename, m.label, 'train' AS side FROM later l JOIN manifest m USING (filename) JOIN folds f USING (filename) WHERE l.training_use AND fold <> 1 UNION ALL SELECT m.filename, m.label, 'val' FROM manifest m JOIN folds f USING (filename) WHERE m.label IS NOT NULL AND fold = 1"))
def cv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir)
    labels = rows.filter("label is not null").select("filename", "label")
    index = A.later_duplicates(rows).filter("training_use").select("filename").join(labels, "filename")
    return K.split(index, labels, _folds(spark, sf_dir), 1)


@query(sql(MANIFEST_SQL, FOLDS_SQL, "s AS (SELECT filename AS foreground, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS other FROM manifest WHERE doc_id % 2 = 0)", body="SELECT s.foreground, m.filename AS background FROM s JOIN manifest m ON m.doc_id = s.other JOIN folds a ON a.filename = s.foreground JOIN folds b ON b.filename = m.filename WHERE a.fold <> 2 AND b.fold <> 2"))
def copy_paste_fold_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).select("doc_id", "filename")
    size = rows.agg(F.count(F.lit(1)).alias("size"))
    fg = rows.filter("doc_id % 2 = 0").crossJoin(F.broadcast(size)).select(F.col("filename").alias("foreground"), ((F.col("doc_id") * 7 + 3) % F.col("size")).alias("doc_id"))
    made = fg.join(rows.withColumnRenamed("filename", "background"), "doc_id").select("foreground", "background")
    return K.fold_safe(made, _folds(spark, sf_dir), 2).select("foreground", "background")


APPLIED_SQL = "applied AS (SELECT m.filename, m.label, coalesce(d.reviewed_label, m.label) AS new_label FROM manifest m LEFT JOIN decisions d USING (filename) WHERE m.label IS NOT NULL)"


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).filter("label is not null").select("filename", "label")
    return R.applied(rows, decisions(spark, sf_dir))


@query(sql(MANIFEST_SQL, DECISIONS_SQL, APPLIED_SQL, body="SELECT label, new_label, count(*) AS n FROM applied WHERE label <> new_label GROUP BY ALL"))
def apply_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changes(_applied(spark, sf_dir))


GUESS = "CASE WHEN substr(filename, 1, 1) IN ('1', '2', '3') THEN 'bad' ELSE 'good' END"
TWO_SQL = "class AS (SELECT unnest([0, 1])::INT AS class_id)"


def _guess() -> F.Column:
    return F.when(F.substring("filename", 1, 1).isin("1", "2", "3"), "bad").otherwise("good")


@query(sql(MANIFEST_SQL, DECISIONS_SQL, APPLIED_SQL, TWO_SQL, f"counts AS (SELECT CASE new_label WHEN 'good' THEN 1 ELSE 0 END AS true_id, CASE {GUESS} WHEN 'good' THEN 1 ELSE 0 END AS pred_id, count(*) AS n FROM applied GROUP BY ALL)", class_sql(), body=metric_sql("zerofill")))
def rescore_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the same predictions against reviewed labels."""
    number = lambda c: F.when(c == "good", 1).otherwise(0)
    rows = _applied(spark, sf_dir).select(number(F.col("new_label")).alias("true_id"), number(_guess()).alias("pred_id"))
    return rounded(metrics(rows, 2, "zerofill")).select(*METRIC_COLUMNS)


@query(sql(MANIFEST_SQL, DECISIONS_SQL, APPLIED_SQL, body=f"SELECT CASE WHEN label = new_label THEN 'unchanged' WHEN g <> label AND g = new_label THEN 'becomes_correct' WHEN g = label AND g <> new_label THEN 'becomes_error' ELSE 'stays_error' END AS impact, count(*) AS n FROM (SELECT *, {GUESS} AS g FROM applied) GROUP BY 1"))
def label_change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _applied(spark, sf_dir)
    return rows.groupBy(R.change_impact(F.col("label"), F.col("new_label"), _guess()).alias("impact")).agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        MANIFEST_SQL, "rowed AS (SELECT sha256(sha256(relative_path) || coalesce(sha256(label), '-') || coalesce(sha256(sha256), '-')) AS h FROM manifest)",
        "same AS (SELECT h, h || ':' || count(*) AS said FROM rowed GROUP BY h)", "parts AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(said, ';' ORDER BY said)) AS d FROM same GROUP BY 1)",
        body="SELECT sha256(string_agg(d, '' ORDER BY p)) AS digest FROM parts",
    )
)
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the manifest's rows in any order."""
    return A.digest(manifest(spark, sf_dir), "relative_path", "label", "sha256")


@query(sql(MANIFEST_SQL, body="SELECT filename, width::VARCHAR AS width, height::VARCHAR AS height, 'good' AS label FROM manifest WHERE split = 'test'"))
def export_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.submission(manifest(spark, sf_dir).filter("split = 'test'"), "good")


TOP_SQL = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
c AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, q.label = b.label AS same, round(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * b.v[i])), 6) AS cosine FROM unit q, unit b WHERE q.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id) AS rank FROM c QUALIFY rank <= 5)"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return S.cosine_topk(rows.filter("id % 5 = 0"), rows.filter("id % 5 <> 0"), 5)


@query(sql(TOP_SQL, body="SELECT query_id, rank, base_id, round(cosine, 4) AS cosine FROM top"))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "base_id", F.round("cosine", 4).alias("cosine"))


@query(sql(TOP_SQL, body="SELECT query_id, rank, base_id, round(cosine, 4) AS cosine FROM top"))
def nearest_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of ``cosine_topk`` by an index whose bounds are exact."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found, _ = S.CellIndex(rows.filter("id % 5 <> 0")).search(rows.filter("id % 5 = 0"), 5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "base_id", F.round("cosine", 4).alias("cosine"))


@query(sql(TOP_SQL, "s AS (SELECT query_id, base_id, rank, round((cosine + least(((base_id % 10) + 1) / 8.0, 1.0)) / 2, 6) AS score FROM top)", body="SELECT query_id, base_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) = 1"))
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _top(spark, sf_dir).withColumn("ratio", (F.col("base_id") % 10 + 1) / 8.0)
    return S.best_match(rows).select("query_id", "base_id", F.round("score", 4).alias("score"))


@query(sql(TOP_SQL, body="SELECT query_id, CASE WHEN same THEN 'direct' WHEN cosine >= 0.4 THEN 'possible' WHEN cosine >= 0.3 THEN 'candidate' ELSE 'unseen' END AS status FROM top WHERE rank = 1"))
def overlap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q, b = (labels.select(F.col("vec_id").alias(f"{k}_id"), F.col("label").alias(f"{k}_label")) for k in ("query", "base"))
    rows = _top(spark, sf_dir).filter("rank = 1").join(q, "query_id").join(b, "base_id")
    return rows.select("query_id", S.overlap_status(F.col("cosine"), F.col("query_label") == F.col("base_label"), 0.4, 0.3).alias("status"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 AND label IN (SELECT label FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 = 0)")
def direct_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    known = rows.filter("vec_id % 5 <> 0 and vec_id % 3 = 0").select("label").distinct()
    return rows.filter("vec_id % 5 = 0").join(known, "label", "left_semi").select("vec_id")


@query(sql(MANIFEST_SQL, "r AS (SELECT p_partkey AS range_id, p_partkey * 5 AS lo, p_partkey * 5 + p_size % 4 AS hi, CASE p_size % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split FROM part)", body="SELECT m.filename, r.range_id FROM manifest m JOIN r ON m.split = r.split AND m.frame_id BETWEEN r.lo AND r.hi"))
def range_join_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in reviewed ranges: ranges are cut into buckets, so that it is an equi-join."""
    size = F.col("p_size")
    ranges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("range_id"), (F.col("p_partkey") * 5).alias("lo"), (F.col("p_partkey") * 5 + size % 4).alias("hi"), F.when(size % 2 == 0, "train").otherwise("test").alias("split"))
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    rows = manifest(spark, sf_dir).filter("frame_id is not null").select("filename", "split", "frame_id", F.floor(F.col("frame_id") / 64).alias("bucket"))
    return rows.join(ranges, ["split", "bucket"]).filter("frame_id between lo and hi").select("filename", "range_id")
