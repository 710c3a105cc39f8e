"""Versioned repositories: heads, logs, trees, snapshots, commits and access.

Conversations play commit chains (a turn's parent is the turn before), documents the files of one repository
(source/lang/doc_id.txt), pages a tree of URL paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.chunks import oid, spread
from cairn.registry import query, table
from cairn.scratch import written


def document_tree(docs: DataFrame) -> DataFrame:
    data = F.col("text").cast("binary")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), F.octet_length(data).cast("bigint").alias("size"), oid(data).alias("cas_hash"))


TREE_SQL = "tree AS (SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, octet_length(encode(text)) AS size, sha256(text) AS cas_hash FROM documents)"


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*/?", ""), r"[?#].*$", "")


def under(path: Column, prefix: str) -> Column:
    """The path itself or what lies below it; "startswith" reaches the scan, and a name that merely begins alike stays out."""
    p = prefix.strip("/")
    return F.lit(True) if not p else (path == p) | path.startswith(p + "/")


@query("""SELECT page_id, path, size, cas_hash FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/?', ''), '[?#].*$', '') AS path, octet_length(encode(html)) AS size, sha256(html) AS cas_hash FROM pages)
WHERE path = 'en' OR starts_with(path, 'en/')""")
def q23_tree_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("html").cast("binary")
    tree = table(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"), F.octet_length(data).cast("bigint").alias("size"), oid(data).alias("cas_hash"))
    return tree.where(under(F.col("path"), "en")).orderBy("path")


def list_tree(tree: DataFrame, prefix: str = "", recursive: bool = False) -> DataFrame:
    """path, kind, size. Recursive: files, relative to the prefix. Else the next level: files and first-seen directories, with full paths."""
    p = prefix.strip("/")
    head = p + "/" if p else ""
    inside = tree.where(under(F.col("path"), p) & (F.col("path") != p)).withColumn("rest", F.expr(f"substring(path, {len(head) + 1})"))
    if recursive:
        return inside.select(F.col("rest").alias("path"), F.lit("file").alias("kind"), "size").orderBy("path")
    deeper = F.instr("rest", "/") > 0
    folders = inside.where(deeper).select(F.concat(F.lit(head), F.substring_index("rest", "/", 1)).alias("path")).distinct()
    files = inside.where(~deeper).select("path", F.lit("file").alias("kind"), "size")
    return files.unionByName(folders.select("path", F.lit("directory").alias("kind"), F.lit(None).cast("bigint").alias("size"))).orderBy("path")


@query(f"WITH {TREE_SQL} SELECT DISTINCT 'src0/' || split_part(path, '/', 2) AS path, 'directory' AS kind, NULL::BIGINT AS size FROM tree WHERE starts_with(path, 'src0/')")
def q24_tree_nonrecursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_tree(document_tree(table(spark, sf_dir, "documents")), "src0")


@query(f"WITH {TREE_SQL} SELECT substr(path, 6) AS path, 'file' AS kind, size FROM tree WHERE starts_with(path, 'src0/')")
def q25_tree_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_tree(document_tree(table(spark, sf_dir, "documents")), "src0", recursive=True)


INLINE_BYTES = 2048


def revision_kind(revision: Column) -> Column:
    """What a revision names: eight or more hex digits a commit, main the head; else it is an error."""
    return F.when(revision.rlike("^[0-9a-fA-F]{8,}$"), "commit").when(revision == "main", "head").otherwise("error")


@query(f"""WITH {TREE_SQL} SELECT event_id, CASE WHEN event_type = 'view' THEN 'head' WHEN event_type = 'click' THEN 'commit' ELSE 'error' END AS revision_kind, path,
CASE WHEN cas_hash IS NULL THEN 'not_found' WHEN size <= 2048 THEN 'inline' ELSE 'redirect' END AS answer FROM events LEFT JOIN tree ON doc_id = user_id""")
def q26_resolve_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for the file of its user's number."""
    revision = F.when(F.col("event_type") == "view", "main").when(F.col("event_type") == "click", "0123abcd").otherwise("dev")
    asked = table(spark, sf_dir, "events").select("event_id", revision_kind(revision).alias("revision_kind"), F.col("user_id").alias("doc_id"))
    answer = F.when(F.col("cas_hash").isNull(), "not_found").when(F.col("size") <= INLINE_BYTES, "inline").otherwise("redirect")
    return asked.join(document_tree(table(spark, sf_dir, "documents")), "doc_id", "left").select("event_id", "revision_kind", "path", answer.alias("answer"))


LOG_LIMIT = 5


def commit_log(revisions: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """repo, depth, commit, by repo and depth: from the head along the parents, at most `limit` (the head at least). revisions: repo, commit, parent; heads: repo, commit.

    Jumps double: the commits at depths below 2^k and the table of 2^k-fold parents give those below 2^(k+1). So any
    limit takes log2(limit) rounds of equal joins over written tables, and neither levels nor rows are bounded.
    """
    limit = max(limit, 1)
    jumps = revisions.select("repo", "commit", F.col("parent").alias("to")).where("to IS NOT NULL")
    log = heads.join(revisions.select("repo", "commit"), ["repo", "commit"]).select("repo", F.lit(0).cast("int").alias("depth"), "commit")
    there = revisions.select("repo", F.col("commit").alias("to"))
    reach = 1
    jumps, _ = written(jumps.join(there, ["repo", "to"], "left_semi").select("repo", "commit", "to"), "jumps")
    while reach < limit:
        further = log.join(jumps, ["repo", "commit"]).where(F.col("depth") + reach < limit).select("repo", (F.col("depth") + reach).cast("int").alias("depth"), F.col("to").alias("commit"))
        reach *= 2
        if reach >= limit:
            log = log.unionByName(further)
            break
        before = log.count()
        log, _ = written(log.unionByName(further), "log")
        if log.count() == before:
            break  # every head's history has ended
        onward = jumps.select("repo", F.col("commit").alias("to"), F.col("to").alias("next"))
        jumps, _ = written(jumps.join(onward, ["repo", "to"]).select("repo", "commit", F.col("next").alias("to")), "jumps")
    return log.orderBy("repo", "depth")


@query(f"SELECT conv_id AS repo, (last - turn)::INT AS depth, turn AS commit FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE last - turn < {LOG_LIMIT}")
def q27_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    revisions = turns.select(F.col("conv_id").alias("repo"), F.col("turn").alias("commit"), (F.col("turn") - 1).alias("parent"))
    return commit_log(revisions, revisions.groupBy("repo").agg(F.max("commit").alias("commit")), LOG_LIMIT)


@query("SELECT conv_id, max(turn) AS head, arg_max(role, turn) AS author, count(*) AS commits FROM conversations GROUP BY conv_id")
def q28_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("head"), F.max_by("role", "turn").alias("author"), F.count("*").alias("commits"))


def snapshot(parent: DataFrame, added: DataFrame, deleted: DataFrame, commit: str, inherit: bool = True) -> DataFrame:
    """The tree after a commit: the parent's entries that aren't deleted nor replaced, and the new ones. All columns but path come along.

    inherit=False gives only what the commit itself adds, as a listing by its commit id alone would.
    """
    new = added.withColumn("commit_id", F.lit(commit))
    if not inherit:
        return new
    return parent.join(deleted.select("path").union(added.select("path")), "path", "left_anti").unionByName(new)


@query(f"""WITH {TREE_SQL}, a AS (SELECT path, size, sha256(reverse(text)) AS cas_hash FROM tree JOIN documents USING (doc_id) JOIN labels USING (doc_id) WHERE quality = 1),
d AS (SELECT path FROM tree WHERE path LIKE '%/fr/%')
SELECT path, size, cas_hash, 'c1' AS commit_id FROM tree WHERE path NOT IN (SELECT path FROM d) AND path NOT IN (SELECT path FROM a)
UNION ALL SELECT path, size, cas_hash, 'c2' FROM a""")
def q29_snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that deletes the French files and rewrites those labelled good; a file both deleted and added stays."""
    docs = table(spark, sf_dir, "documents")
    tree = document_tree(docs)
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    added = document_tree(good).drop("cas_hash").join(good.select("doc_id", F.sha2(F.reverse("text"), 256).alias("cas_hash")), "doc_id").select("path", "size", "cas_hash")
    deleted = tree.where(F.col("path").contains("/fr/"))
    return snapshot(tree.select("path", "size", "cas_hash", F.lit("c1").alias("commit_id")), added, deleted, "c2")


def head_conflict(expected: Column, head: Column) -> Column:
    """A commit may go on only from the head that it names; naming none is right only where there is none."""
    return F.when(expected.eqNullSafe(head), "ok").when(head.isNull(), "unknown_parent").when(expected.isNull(), "parent_required").otherwise("conflict")


@query("""WITH h AS (SELECT conv_id, max(turn) AS head FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT c.conv_id, turn, CASE WHEN e IS NOT DISTINCT FROM head THEN 'ok' WHEN head IS NULL THEN 'unknown_parent' WHEN e IS NULL THEN 'parent_required' ELSE 'conflict' END AS outcome
FROM (SELECT *, nullif(turn, 0) AS e FROM conversations) c LEFT JOIN h USING (conv_id)""")
def q30_head_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a commit on top of itself; turn 0 names no parent."""
    turns = table(spark, sf_dir, "conversations")
    heads = turns.where("role <> 'system'").groupBy("conv_id").agg(F.max("turn").alias("head"))
    return turns.join(heads, "conv_id", "left").select("conv_id", "turn", head_conflict(F.expr("nullif(turn, 0)"), F.col("head")).alias("outcome"))


OPERATION = "struct<key:string,value:struct<summary:string,parentRevision:string,path:string,content:string,encoding:string,oid:string,size:bigint>>"
KEYS = ("header", "file", "lfsFile", "deletedFile")


def parse_operations(lines: DataFrame, column: str = "line") -> DataFrame:
    """key, path, oid, data (decoded content) and error, for each line that isn't blank. Content may start with base64: and must be padded."""
    got = lines.where(F.trim(column) != "").select(F.from_json(column, OPERATION).alias("op"))
    content = F.regexp_replace("op.value.content", "^base64:", "")
    data = F.when(F.length(content) % 4 == 0, F.try_to_binary(content, F.lit("base64")))
    error = F.when(F.col("op.key").isNull(), "malformed").when(~F.col("op.key").isin(*KEYS), "unknown key").when((F.col("op.key") == "file") & data.isNull(), "bad content")
    return got.select("op.key", "op.value.path", "op.value.oid", data.alias("data"), error.alias("error"))


@query("""SELECT key, path, size, sha, error FROM (
  SELECT 'file' AS key, source || '/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha, NULL::VARCHAR AS error FROM documents
  UNION ALL SELECT 'deletedFile', lang || '/' || doc_id, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'other', NULL, NULL, NULL, 'unknown key' FROM labels)""")
def q31_ndjson_commit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    name = F.col("doc_id").cast("string")
    op = lambda key, *fields: F.to_json(F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value"))).alias("line")
    file = op("file", F.concat_ws("/", "source", name).alias("path"), F.concat(F.lit("base64:"), F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")).alias("content"))
    gone = op("deletedFile", F.concat_ws("/", "lang", name).alias("path"))
    other = table(spark, sf_dir, "labels").select(op("other", F.col("doc_id").alias("size")))
    return parse_operations(docs.select(F.explode(F.array(file, gone)).alias("line")).union(other)).select("key", "path", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha"), "error")


NOW = 0


@query("""WITH t AS (SELECT c_custkey AS token, c_nationkey AS user_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN floor(c_acctbal)::BIGINT END AS expires_at,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END AS revoked_at FROM customer)
SELECT token, n_name AS username, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at < 0 THEN 'expired' ELSE 'valid' END AS state FROM t JOIN nation ON n_nationkey = user_id""")
def q35_token_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' tokens joined with their users; one that expires just now is still valid."""
    expires = F.when(F.col("c_mktsegment") != "BUILDING", F.floor("c_acctbal"))
    state = F.when(F.col("c_mktsegment") == "MACHINERY", "revoked").when(expires < NOW, "expired").otherwise("valid")
    tokens = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("n_nationkey"), state.alias("state"))
    return tokens.join(table(spark, sf_dir, "nation"), "n_nationkey").select("token", F.col("n_name").alias("username"), "state")


@query("""SELECT o_orderkey, NOT private OR owner = reader AS can_read, owner = reader AS can_write FROM (
  SELECT o_orderkey, c_acctbal < 0 AS private, c_nationkey AS owner, o_custkey % 25 AS reader FROM orders JOIN customer ON c_custkey = o_custkey)""")
def q36_repo_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for its customer's repository, which is private if the balance is negative."""
    asked = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    owner = F.col("c_nationkey") == F.col("o_custkey") % 25
    return asked.select("o_orderkey", ((F.col("c_acctbal") >= 0) | owner).alias("can_read"), owner.alias("can_write"))


@query("SELECT conv_id, turn, sha256(concat_ws(':', conv_id, turn - 1, text, turn, 'nonce')) AS commit_id FROM conversations")
def q48_commit_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository, parent, message, time and a nonce that the caller gives, so that reruns agree."""
    text = lambda c: F.col(c).cast("string")
    joined = F.concat_ws(":", text("conv_id"), (F.col("turn") - 1).cast("string"), "text", text("turn"), F.lit("nonce"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(joined, 256).alias("commit_id"))


def upsert(tree: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of equal keys."""
    return tree.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new keys, once each; the caller appends them. Those present are left as they are."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


@query("""SELECT n_nationkey AS repo, count(c_custkey) AS revisions FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment <> 'BUILDING' WHERE n_regionkey <> 0 GROUP BY 1""")
def q51_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories (nations) of region 0 deleted with their revisions (customers); those of a segment removed one by one."""
    repos, revisions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    gone = repos.where("n_regionkey = 0").select("n_nationkey")
    left = repos.join(gone, "n_nationkey", "left_anti")
    rest = revisions.join(gone, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").where("c_mktsegment <> 'BUILDING'")
    return left.join(rest, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_nationkey").alias("repo")).agg(F.count("c_custkey").alias("revisions"))
