"""What the services around a repository decide and answer: tokens and their claims, batches, exchanges, commits and JSON bodies.

Column expressions and joins; signatures are outside. Events play requests, customers tokens, nations repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.repositories import document_tree, head_conflict, snapshot, upsert
from cairn.operators.rules import WEEK, iso_time, scope_allows, storage_scope_allows
from cairn.registry import query, table

BATCH_OBJECTS, COMMIT_OPERATIONS, COMMIT_BYTES = 1000, 10_000, 20 << 20


def missing_objects(wanted: DataFrame, indexed: DataFrame, raw: DataFrame) -> DataFrame:
    """wanted rows whose oid is neither indexed nor stored raw; each side is a semi-join on hashes alone."""
    return wanted.join(indexed.select("oid"), "oid", "left_anti").join(raw.select("oid"), "oid", "left_anti")


@query("""WITH d AS (SELECT doc_id, lang, sha256(text) AS oid FROM documents WHERE text IS NOT NULL),
have AS (SELECT oid FROM d WHERE lang = 'en' UNION SELECT oid FROM d JOIN labels USING (doc_id))
SELECT doc_id, oid FROM d WHERE oid NOT IN (SELECT oid FROM have)""")
def q59_missing_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit of all documents; English ones are stored raw, labelled ones indexed."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.sha2("text", 256).alias("oid"))
    indexed = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return missing_objects(docs.select("doc_id", "oid"), indexed, docs.where("lang = 'en'"))


def list_tokens(tokens: DataFrame) -> DataFrame:
    """A user's tokens, the newest first, numbered; equal times in the order of their hashes."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "token_hash")
    return tokens.withColumn("place", F.row_number().over(order)).orderBy("user_id", "place")


def create_token(tokens: DataFrame, users: DataFrame, row: DataFrame, user: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tokens and users after a creation: the user is added unless there, the token always."""
    new = user.join(users.select("user_id"), "user_id", "left_anti")
    return tokens.unionByName(row), users.unionByName(new)


def revoke_token(tokens: DataFrame, token_hash: str, now: int) -> DataFrame:
    """Only a token that isn't revoked gets the time."""
    hit = (F.col("token_hash") == token_hash) & F.col("revoked_at").isNull()
    return tokens.withColumn("revoked_at", F.when(hit, F.lit(now)).otherwise(F.col("revoked_at")))


@query("""SELECT c_nationkey AS user_id, c_custkey AS token, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 97 DESC, sha256(c_name)))::INT AS place,
CASE WHEN c_custkey % 11 = 0 THEN 5 WHEN c_mktsegment = 'MACHINERY' THEN 1 END AS revoked_at FROM customer""")
def q60_token_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", 1)
    revoked = F.when(F.col("c_custkey") % 11 == 0, 5).otherwise(segment)
    tokens = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("token"), F.sha2("c_name", 256).alias("token_hash"), (F.col("c_custkey") % 97).alias("created_at"), revoked.alias("revoked_at"))
    return list_tokens(tokens).select("user_id", "token", "place", "revoked_at")


def over_cap(groups: DataFrame, of: list[str], most: int) -> DataFrame:
    """of, objects and error: a batch with more than `most` is refused as a whole, not cut."""
    return groups.groupBy(*of).agg(F.count("*").alias("objects")).withColumn("error", F.when(F.col("objects") > most, F.format_string("%d exceeds %d", "objects", F.lit(most))))


@query(f"SELECT source, lang, count(*) AS objects, CASE WHEN count(*) > {BATCH_OBJECTS // 20} THEN count(*) || ' exceeds {BATCH_OBJECTS // 20}' END AS error FROM documents GROUP BY ALL")
def q61_batch_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_cap(table(spark, sf_dir, "documents"), ["source", "lang"], BATCH_OBJECTS // 20)


def hash_error(c: Column) -> Column:
    """Null for a hash of 64 hex digits of either case."""
    return F.when(c.isNull() | (F.length(c) != 64), "length").when(~c.rlike("^[0-9a-fA-F]*$"), "digits")


def decoded_hash(c: Column) -> Column:
    """The 32 bytes; null where hash_error names an error."""
    return F.when(hash_error(c).isNull(), F.unhex(c))


def first_u64(data: Column) -> Column:
    """The unsigned little-endian number of the first eight bytes, as a decimal."""
    digits = F.concat(*[F.hex(F.substring(data, i, 1)) for i in range(8, 0, -1)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


@query("""SELECT doc_id, CASE WHEN length(oid) <> 64 THEN 'length' WHEN NOT regexp_matches(oid, '^[0-9a-fA-F]*$') THEN 'digits' END AS error,
CASE WHEN length(oid) = 64 AND regexp_matches(oid, '^[0-9a-fA-F]*$') THEN lower(oid) END AS hash,
CASE WHEN length(oid) = 64 AND regexp_matches(oid, '^[0-9a-fA-F]*$') THEN (list_sum(list_transform(range(0, 8), lambda i: ('0x' || oid[2 * i + 1:2 * i + 2])::INT::HUGEINT * (256::HUGEINT ** i)::HUGEINT)))::DECIMAL(20,0) END AS number
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN sha256(text) WHEN 'de' THEN upper(sha256(text)) WHEN 'fr' THEN substr(sha256(text), 3) ELSE 'g' || substr(sha256(text), 2) END AS oid FROM documents WHERE text IS NOT NULL)""")
def q62_hash_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    given = F.when(F.col("lang") == "en", h).when(F.col("lang") == "de", F.upper(h)).when(F.col("lang") == "fr", F.substr(h, F.lit(3))).otherwise(F.concat(F.lit("g"), F.substr(h, F.lit(2))))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", given.alias("oid"))
    data = decoded_hash(F.col("oid"))
    return docs.select("doc_id", hash_error(F.col("oid")).alias("error"), F.lower(F.hex(data)).alias("hash"), first_u64(data).alias("number"))


CLAIMS = "struct<sub:string,scope:string,repo_id:string,repo_type:string,revision:string,exp:bigint,iat:bigint,kid:string,token_type:string,oid:string,operation:string>"
HEADER = "struct<alg:string,typ:string,kid:string>"
#: Prefix of a token and the type that its claims must name.
TOKEN_KINDS = {"user": "user", "proxy": "proxy", "internal": "internal"}


def decode_token(token: Column) -> Column:
    """kind, parts, header and claims of prefix_header.claims.signature, in URL-safe base64 without padding."""
    kind = F.regexp_extract(token, "^([a-z]+)_", 1)
    parts = F.split(F.regexp_replace(token, "^[a-z]+_", ""), r"\.")

    def plain(part: Column) -> Column:
        padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), "=")
        return F.try_to_binary(padded, F.lit("base64")).cast("string")

    header, claims = F.from_json(plain(F.get(parts, F.lit(0))), HEADER), F.from_json(plain(F.get(parts, F.lit(1))), CLAIMS)
    return F.struct(kind.alias("kind"), F.size(parts).alias("parts"), header.alias("header"), claims.alias("claims"))


def token_error(decoded: Column, kid: str, now: int) -> Column:
    """The first check that fails, signatures aside; null for a good token."""
    claims, header, kind = decoded["claims"], decoded["header"], decoded["kind"]
    proxy = F.forall(F.split(F.trim(claims["scope"]), r"\s+"), lambda s: s.startswith("lfs-"))
    typed = F.create_map(*[F.lit(x) for kv in TOKEN_KINDS.items() for x in kv])[kind]
    return (
        F.when(typed.isNull(), "prefix").when(decoded["parts"] != 3, "parts").when(header["alg"].isNull(), "header")
        .when((header["alg"] != "EdDSA") | ~header["typ"].eqNullSafe("JWT"), "algorithm").when(~header["kid"].eqNullSafe(kid), "key")
        .when(claims["token_type"].isNull(), "claims").when(~claims["kid"].eqNullSafe(kid), "key").when(claims["token_type"] != typed, "type")
        .when(claims["exp"] < now, "expired").when(claims["iat"] > now, "issued later").when(now - claims["iat"] > WEEK, "too old").when((kind == "proxy") & ~proxy, "proxy scope")
    )


@query(f"""SELECT event_id, CASE WHEN k = 0 THEN 'prefix' WHEN k = 1 THEN 'parts' WHEN k = 2 THEN 'header' WHEN k = 3 THEN 'algorithm' WHEN k = 4 THEN 'key' WHEN k = 5 THEN 'key' WHEN k = 6 THEN 'type' WHEN exp < 1000000 THEN 'expired'
WHEN iat > 1000000 THEN 'issued later' WHEN 1000000 - iat > {WEEK} THEN 'too old' WHEN k = 7 THEN 'proxy scope' END AS error
FROM (SELECT event_id, event_id % 13 AS k, 999000 + event_id % 5000 AS exp, 1000100 - event_id * 97 % 900000 AS iat FROM events)""")
def q63_token_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole token for each event, of which seven in thirteen are wrong in a way of their own."""
    k = F.col("event_id") % 13
    safe = lambda c: F.regexp_replace(F.translate(F.base64(c.cast("binary")), "+/\r\n", "-_"), "=", "")
    header = F.to_json(F.struct(F.when(k == 3, "none").otherwise("EdDSA").alias("alg"), F.lit("JWT").alias("typ"), F.when(k == 4, "k0").otherwise("k1").alias("kid")))
    kind = F.when(k.isin(7, 8), "proxy").otherwise("user")
    claims = F.to_json(F.struct(
        F.when(k == 7, "lfs-upload write").when(k == 8, "lfs-upload lfs-verify").otherwise("read").alias("scope"), (999000 + F.col("event_id") % 5000).alias("exp"), (1000100 - F.col("event_id") * 97 % 900000).alias("iat"),
        F.when(k == 5, "k0").otherwise("k1").alias("kid"), F.when(k == 6, "internal").otherwise(kind).alias("token_type"),
    ))
    body = F.concat_ws(".", F.when(k == 2, "%%").otherwise(safe(header)), safe(claims), F.when(k != 1, "c2ln"))
    token = F.concat(F.when(k == 0, "robot").otherwise(kind), F.lit("_"), body)
    return table(spark, sf_dir, "events").select("event_id", token_error(decode_token(token), "k1", 1000000).alias("error"))


#: Operations on an object: the scope of a regular token, and of a proxy token.
OPERATIONS = {"download": ("read", "lfs-download"), "upload": ("write", "lfs-upload"), "verify": ("write", "lfs-verify")}


def object_allowed(claims: Column, operation: str, oid: Column) -> Column:
    """A proxy token is bound to its object and operation; any other needs the operation's regular scope."""
    regular, proxy = OPERATIONS[operation]
    bound = F.array_contains(F.split(F.trim(claims["scope"]), r"\s+"), proxy) & claims["oid"].eqNullSafe(oid) & claims["operation"].eqNullSafe(F.lit(operation))
    return F.when(claims["token_type"] == "proxy", bound).otherwise(storage_scope_allows(claims["scope"], regular, claims["token_type"]))


def internal_token(claims: Column) -> Column:
    """A service's own token: subject, scope and type must all say so."""
    return claims["sub"].eqNullSafe(F.lit("hub-service")) & F.array_contains(F.split(F.trim(claims["scope"]), r"\s+"), "internal") & claims["token_type"].eqNullSafe(F.lit("internal"))


@query("""SELECT event_id, CASE WHEN k = 0 THEN user_id % 2 = 0 WHEN k IN (1, 4) THEN FALSE WHEN k = 2 THEN TRUE ELSE FALSE END AS can_download, k = 3 AS can_upload, k = 5 AS internal
FROM (SELECT event_id, user_id, event_id % 7 AS k FROM events)""")
def q64_object_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy tokens (bound to every other object, or to another operation), user tokens that read or write, and internal ones, one without its scope."""
    k, u = F.col("event_id") % 7, F.col("user_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k + 1).cast("int"))
    oid = F.concat(F.lit("o"), u.cast("string"))
    claims = F.struct(
        pick("a", "a", "a", "a", "a", "hub-service", "hub-service").alias("sub"), pick("x lfs-download", "lfs-download", "read", "write", "internal read", "internal", "read").alias("scope"),
        pick("proxy", "proxy", "user", "user", "user", "internal", "internal").alias("token_type"), F.when(u % 2 == 0, oid).otherwise("other").alias("oid"), pick("download", "upload", None, None, None, None, None).alias("operation"),
    )
    e = table(spark, sf_dir, "events").select("event_id", claims.alias("c"), oid.alias("oid"))
    return e.select("event_id", object_allowed(F.col("c"), "download", F.col("oid")).alias("can_download"), object_allowed(F.col("c"), "upload", F.col("oid")).alias("can_upload"), internal_token(F.col("c")).alias("internal"))


def exchange(requests: DataFrame, repos: DataFrame, heads: DataFrame) -> DataFrame:
    """request, outcome and revision: not found where the repository isn't, or may not be read (or written) by the user; main and nothing mean the head, and main where there is none.

    requests: request, repo, username, scope, revision; repos: repo, namespace, private; heads: repo, commit.
    """
    found = requests.join(repos, "repo", "left").join(heads, "repo", "left")
    owner = F.col("namespace") == F.col("username")
    allowed = F.when(F.col("scope") == "write", owner).otherwise(~F.col("private") | owner)
    ok = F.coalesce(allowed, F.lit(False))
    revision = F.when(F.col("revision").isin("main", ""), F.coalesce("commit", F.lit("main"))).otherwise(F.col("revision"))
    return found.select("request", F.when(ok, "granted").otherwise("not found").alias("outcome"), F.when(ok, revision).alias("revision"))


@query("""WITH heads AS (SELECT c_nationkey AS repo, max(c_custkey) AS commit FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
r AS (SELECT o_orderkey AS request, o_orderkey % 30 AS repo, o_custkey % 25 AS who, o_orderpriority LIKE '1%' AS writes, CASE o_orderstatus WHEN 'F' THEN 'main' WHEN 'O' THEN '' ELSE 'v1' END AS revision FROM orders),
j AS (SELECT r.*, n.n_nationkey IS NOT NULL AND (who = n_nationkey OR NOT writes AND n_regionkey <> 0) AS ok, commit FROM r LEFT JOIN nation n ON n_nationkey = repo LEFT JOIN heads USING (repo))
SELECT request, CASE WHEN ok THEN 'granted' ELSE 'not found' END AS outcome, CASE WHEN ok THEN CASE WHEN revision IN ('main', '') THEN coalesce('c' || commit, 'main') ELSE revision END END AS revision FROM j""")
def q65_token_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = lambda x: x.cast("string")
    heads = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(c("c_nationkey").cast("bigint").alias("repo")).agg(F.concat(F.lit("c"), text(F.max("c_custkey"))).alias("commit"))
    repos = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("bigint").alias("repo"), text(c("n_nationkey")).alias("namespace"), (c("n_regionkey") == 0).alias("private"))
    revision = F.when(c("o_orderstatus") == "F", "main").when(c("o_orderstatus") == "O", "").otherwise("v1")
    requests = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("request"), (c("o_orderkey") % 30).alias("repo"), text(c("o_custkey") % 25).alias("username"), F.when(c("o_orderpriority").startswith("1"), "write").otherwise("read").alias("scope"), revision.alias("revision"))
    return exchange(requests, repos, heads)


def batch_outcome(operation: Column, scope: Column, objects: Column, most: int = BATCH_OBJECTS) -> Column:
    """What a batch request gets before any object is looked at; without an operation it downloads."""
    wanted = F.coalesce(operation, F.lit("download"))
    enough = F.when(wanted == "upload", scope_allows(scope, "write")).otherwise(scope_allows(scope, "read"))
    return F.when(scope.isNull(), "invalid token").when(~wanted.isin("upload", "download"), "invalid operation").when(~enough, "insufficient scope").when(objects > most, "too many objects").otherwise("ok")


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid token' WHEN event_id % 5 = 4 THEN 'invalid operation' WHEN event_id % 5 IN (0, 1) AND event_type NOT IN ('click', 'purchase') THEN 'insufficient scope'
WHEN user_id * 11 > {BATCH_OBJECTS} THEN 'too many objects' ELSE 'ok' END AS outcome FROM events""")
def q66_lfs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id") % 5, F.col("event_type")
    operation = F.when(k.isin(0, 1), "upload").when(k == 2, "download").when(k == 4, "delete")
    scope = F.when(kind.isin("click", "purchase"), "read write").when(kind != "error", "read")
    return table(spark, sf_dir, "events").select("event_id", batch_outcome(operation, scope, F.col("user_id") * 11).alias("outcome"))


def namespace_write(requests: DataFrame, members: DataFrame) -> DataFrame:
    """requests with allowed: the namespace is the user's own, or the user a member of it. members: username, namespace."""
    inside = members.select("username", "namespace").distinct().withColumn("member", F.lit(True))
    own = F.col("username") == F.col("namespace")
    return requests.join(inside, ["username", "namespace"], "left").withColumn("allowed", F.coalesce(own, F.lit(False)) | F.col("member").isNotNull()).drop("member")


@query("""SELECT o_orderkey, c_nationkey = o_orderkey % 25 OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c_nationkey AND s.s_suppkey % 25 = o_orderkey % 25) AS allowed FROM orders JOIN customer ON c_custkey = o_custkey""")
def q67_namespace_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders commit to a namespace by their number as their customer's nation; suppliers are memberships."""
    asked = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").cast("bigint").alias("username"), (F.col("o_orderkey") % 25).alias("namespace"))
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("username"), (F.col("s_suppkey") % 25).alias("namespace"))
    return namespace_write(asked, members).select("o_orderkey", "allowed")


def base_url(public: Column, host: Column, port: Column) -> Column:
    """The public address without slashes at its end, else http://host:port."""
    return F.regexp_replace(F.coalesce(public, F.concat(F.lit("http://"), host, F.lit(":"), port.cast("string"))), "/+$", "")


def base_url_error(public: Column) -> Column:
    """Null for no public address or one with a scheme and a host."""
    bare = F.regexp_replace(public, "/+$", "")
    return F.when(~bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "no address").when(~bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), "no host")


@query(r"""SELECT page_id, regexp_replace(coalesce(public, 'http://h:' || page_id), '/+$', '') AS base, CASE WHEN public IS NULL THEN NULL WHEN page_id % 5 = 1 THEN 'no address' WHEN page_id % 5 = 2 THEN 'no host' END AS error
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'host/' || page_id WHEN 2 THEN 'http:///' WHEN 3 THEN url || '//' ELSE url END AS public FROM pages WHERE url IS NOT NULL)""")
def q68_base_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    public = F.when(k == 1, F.concat(F.lit("host/"), n)).when(k == 2, "http:///").when(k == 3, F.concat("url", F.lit("//"))).when(k == 4, F.col("url"))
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").withColumn("public", public)
    return pages.select("page_id", base_url(F.col("public"), F.lit("h"), F.col("page_id")).alias("base"), base_url_error(F.col("public")).alias("error"))


def repo_json(namespace: Column, name: Column, private: Column, created: Column, updated: Column) -> Column:
    full = F.concat_ws("/", namespace, name)
    return F.to_json(F.struct(
        full.alias("id"), name.alias("name"), private.alias("private"), iso_time(created).alias("createdAt"), iso_time(updated).alias("updatedAt"), F.array().cast("array<string>").alias("tags"),
        F.lit(0).alias("downloads"), F.lit(0).alias("likes"), F.concat(F.lit("/"), full).alias("url"),
    ))


def whoami_json(username: Column, token_name: Column, scope: Column) -> Column:
    token = F.struct(token_name.alias("displayName"), scope.alias("role"))
    return F.to_json(F.struct(username.alias("name"), F.lit("").alias("email"), F.array().cast("array<string>").alias("orgs"), F.struct(F.lit("access_token").alias("type"), token.alias("accessToken")).alias("auth")))


def tree_json(kind: Column, oid: Column, size: Column, path: Column) -> Column:
    """An entry of a listing; a directory has neither oid nor size."""
    return F.to_json(F.struct(kind.alias("type"), oid.alias("oid"), size.alias("size"), path.alias("path")))


@query("""SELECT c_custkey, '{"id":"' || n_name || '/' || replace(c_name, '#', '-') || '","name":"' || replace(c_name, '#', '-') || '","private":' || (c_acctbal < 0) || ',"createdAt":"' || strftime(make_timestamp(c_custkey * 86399000000), '%Y-%m-%dT%H:%M:%SZ')
|| '","updatedAt":"' || strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%dT%H:%M:%SZ') || '","tags":[],"downloads":0,"likes":0,"url":"/' || n_name || '/' || replace(c_name, '#', '-') || '"}' AS body,
'{"name":"' || n_name || '","email":"","orgs":[],"auth":{"type":"access_token","accessToken":{"displayName":"' || replace(c_name, '#', '-') || '","role":"read"}}}' AS me FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def q69_json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.replace(c("c_name"), F.lit("#"), F.lit("-"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("n_nationkey") == c("c_nationkey"))
    return rows.select("c_custkey", repo_json(c("n_name"), name, c("c_acctbal") < 0, c("c_custkey") * 86399, c("c_custkey") * 86400).alias("body"), whoami_json(c("n_name"), name, F.lit("read")).alias("me"))


def resolve_revision(requests: DataFrame, revisions: DataFrame, heads: DataFrame) -> DataFrame:
    """requests (request, repo, revision) with outcome and commit: main is the head, eight or more hex digits a commit of just that id, anything else an error."""
    hexed, main = F.col("revision").rlike("^[0-9a-fA-F]{8,}$"), F.col("revision") == "main"
    known = revisions.select("repo", F.col("commit").alias("revision"), F.lit(True).alias("there"))
    found = requests.join(known, ["repo", "revision"], "left").join(heads.select("repo", F.col("commit").alias("head")), "repo", "left")
    commit = F.when(main, F.col("head")).when(hexed & F.col("there"), F.col("revision"))
    outcome = F.when(commit.isNotNull(), "found").when(main | hexed, "not found").otherwise("invalid")
    return found.select("request", outcome.alias("outcome"), commit.alias("commit"))


@query("""WITH r AS (SELECT conv_id AS repo, substr(sha256(text), 1, 12) AS commit, turn FROM conversations), h AS (SELECT repo, arg_max(commit, turn) AS head FROM r WHERE repo % 3 <> 0 GROUP BY repo),
q AS (SELECT event_id AS request, user_id AS repo, CASE event_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'v1.0' WHEN 2 THEN 'deadbeef' END AS fixed FROM events),
a AS (SELECT request, q.repo, coalesce(fixed, (SELECT min(commit) FROM r WHERE r.repo = q.repo), 'abc') AS revision FROM q)
SELECT request, CASE WHEN revision = 'main' THEN CASE WHEN head IS NULL THEN 'not found' ELSE 'found' END WHEN revision IN ('v1.0', 'abc') THEN 'invalid' WHEN revision = 'deadbeef' THEN 'not found' ELSE 'found' END AS outcome,
CASE WHEN revision = 'main' THEN head WHEN revision NOT IN ('v1.0', 'abc', 'deadbeef') THEN revision END AS commit FROM a LEFT JOIN h USING (repo)""")
def q79_resolve_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ask their user's conversation for its head, a tag, an unknown commit, or its least commit."""
    revisions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("repo"), F.substring(F.sha2("text", 256), 1, 12).alias("commit"), "turn")
    heads = revisions.where("repo % 3 <> 0").groupBy("repo").agg(F.max_by("commit", "turn").alias("commit"))
    k = F.col("event_id") % 4
    fixed = F.when(k == 0, "main").when(k == 1, "v1.0").when(k == 2, "deadbeef")
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("request"), F.col("user_id").alias("repo"), fixed.alias("fixed"))
    least = revisions.groupBy("repo").agg(F.min("commit").alias("least"))
    requests = asked.join(least, "repo", "left").select("request", "repo", F.coalesce("fixed", "least", F.lit("abc")).alias("revision"))
    return resolve_revision(requests, revisions.select("repo", "commit").distinct(), heads)


def little_endian_bytes(value: Column, width: int) -> Column:
    """The lowest `width` bytes (8 at most) of a whole number, the lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


@query("""SELECT o_orderkey, lower(hex(encode(chr((o_orderkey % 100 + 1)::INT)))) || '0000' AS u24, (o_orderkey * 1000003)::DECIMAL(20,0) AS number FROM orders""")
def q80_numbers_as_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small numbers written in three bytes; larger ones written in eight and read back."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.hex(little_endian_bytes(key % 100 + 1, 3))).alias("u24"), first_u64(little_endian_bytes(key * 1000003, 8)).alias("number"))


def create_repo(repos: DataFrame, row: DataFrame, keys: tuple[str, ...] = ("namespace", "name", "repo_type")) -> tuple[DataFrame, str]:
    """repos with the new row, and "created"; or as they were, and "exists"."""
    there = repos.join(row.select(*keys), list(keys), "left_semi").limit(1).count()
    return (repos, "exists") if there else (repos.unionByName(row), "created")


def delete_repos(gone: DataFrame, repos: DataFrame, revisions: DataFrame, heads: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four levels without the repositories in gone (repo_id); blobs stay."""
    return tuple(t.join(gone.select("repo_id"), "repo_id", "left_anti") for t in (repos, revisions, heads, trees))


def set_head(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """heads with the commits of rows (repo_id, commit_id) instead of earlier ones."""
    return upsert(heads, rows, ["repo_id"])


def commit(repo_id: int, expected: str | None, new: DataFrame, added: DataFrame, deleted: DataFrame, revisions: DataFrame, heads: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """revisions, heads and the repository's tree after a commit, and "ok"; or as they were, and why not.

    new: the one row (commit_id, repo_id, parent, ...) of the revision. One writer a repository: the caller swaps the written tables in.
    """
    asked = heads.sparkSession.createDataFrame([(repo_id, expected)], "repo_id bigint, expected string")
    outcome = asked.join(heads, "repo_id", "left").select(head_conflict(F.col("expected"), F.col("commit_id"))).first()[0]
    if outcome != "ok":
        return revisions, heads, tree, outcome
    (row,) = new.select("commit_id").collect()
    return revisions.unionByName(new), set_head(heads, new.select("repo_id", "commit_id")), snapshot(tree, added, deleted, row.commit_id), "ok"


@query("""WITH t AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, source, octet_length(encode(text)) AS size FROM documents),
gone AS (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0)
SELECT source AS repo_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM t WHERE source NOT IN (SELECT source FROM gone WHERE source IS NOT NULL) AND source <> 'src0' OR source IS NULL GROUP BY source
UNION ALL SELECT 'src0', count(*), sum(size)::BIGINT FROM t WHERE source = 'src0' AND 'src0' NOT IN (SELECT source FROM gone WHERE source IS NOT NULL) HAVING count(*) > 0""")
def q70_delete_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as repositories; those with a document whose number 97 divides are deleted with their trees."""
    docs = table(spark, sf_dir, "documents")
    trees = document_tree(docs).join(docs.select("doc_id", F.col("source").alias("repo_id")), "doc_id")
    repos = docs.select(F.col("source").alias("repo_id")).distinct()
    gone = docs.where("doc_id % 97 = 0").select(F.col("source").alias("repo_id")).distinct()
    left = delete_repos(gone, repos, repos, repos, trees)
    return left[3].groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def schema_error(df: DataFrame, expected: str, version: int, newest: int) -> str | None:
    """Why a stored table can't be used: another version, or columns that are missing or of another type. The schema alone is read."""
    if version != newest:
        return f"version {version} is {'newer' if version > newest else 'older'} than {newest}"
    want = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], expected).schema}
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{n}: {have[n].simpleString() if n in have else 'missing'}" for n, kind in want.items() if have.get(n) != kind]
    return "; ".join(wrong) or None


def salt_of(settings: DataFrame, fresh: str) -> tuple[DataFrame, str]:
    """settings (key, value) with a salt, and the salt: the stored one, else the fresh one. The first writer's stays."""
    held = settings.where("key = 'salt'").select("value").first()
    if held:
        return settings, held.value
    return settings.unionByName(settings.sparkSession.createDataFrame([("salt", fresh)], "key string, value string")), fresh


#: The whole export: name, help, type.
METRICS = [
    ("http_requests_total", "Total number of HTTP requests", "counter"), ("http_requests_by_status", "HTTP requests by status code range", "counter"), ("storage_operations_total", "Total number of storage operations", "counter"),
    ("upload_bytes_total", "Total bytes uploaded", "counter"), ("download_bytes_total", "Total bytes downloaded", "counter"), ("errors_total", "Total number of errors", "counter"),
    ("active_connections", "Current number of active connections", "gauge"), ("request_latency_us_total", "Total request latency in microseconds", "counter"), ("request_latency_count", "Total number of latency measurements", "counter"),
]
CLASSES = ("2xx", "3xx", "4xx", "5xx", "other")


def export_metrics(requests: DataFrame) -> DataFrame:
    """place and line of the text export, from requests (class, storage_operations, upload_bytes, download_bytes, opened, latency_us); one aggregation, so the result is one row until its lines are listed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    one = requests.agg(
        F.count("*").alias("http_requests_total"), *[F.count(F.when(F.col("class") == k, 1)).alias(f"class_{k}") for k in CLASSES], total("storage_operations").alias("storage_operations_total"), total("upload_bytes").alias("upload_bytes_total"),
        total("download_bytes").alias("download_bytes_total"), F.count(F.when(F.col("class").isin("4xx", "5xx"), 1)).alias("errors_total"), total("opened").alias("active_connections"), total("latency_us").alias("request_latency_us_total"), F.count("latency_us").alias("request_latency_count"),
    )
    lines = []
    for name, what, kind in METRICS:
        lines += [F.lit(f"# HELP {name} {what}"), F.lit(f"# TYPE {name} {kind}")]
        labelled = [(f'{name}{{status="{k}"}} ', f"class_{k}") for k in CLASSES] if name == "http_requests_by_status" else [(f"{name} ", name)]
        lines += [F.concat(F.lit(label), F.col(column).cast("string")) for label, column in labelled]
    return one.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def _metrics_sql() -> str:
    value = {
        "http_requests_total": "count(*)", "storage_operations_total": "count(*) FILTER (event_type IN ('purchase', 'view'))", "upload_bytes_total": "coalesce(sum(CASE WHEN event_type = 'purchase' THEN event_id % 1000 ELSE 0 END), 0)::BIGINT",
        "download_bytes_total": "coalesce(sum(CASE WHEN event_type = 'view' THEN event_id % 777 ELSE 0 END), 0)::BIGINT", "errors_total": "count(*) FILTER (event_type IN ('signup', 'error'))", "active_connections": "(count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click'))",
        "request_latency_us_total": "coalesce(sum(event_id % 5000), 0)::BIGINT", "request_latency_count": "count(*)",
    }
    kinds = {"2xx": "'view', 'purchase'", "3xx": "'click'", "4xx": "'signup'", "5xx": "'error'", "other": "''"}
    lines = []
    for name, what, kind in METRICS:
        lines += [f"'# HELP {name} {what}'", f"'# TYPE {name} {kind}'"]
        lines += [f"""'{name}{{status="{k}"}} ' || count(*) FILTER (event_type IN ({v}))""" for k, v in kinds.items()] if name == "http_requests_by_status" else [f"'{name} ' || {value[name]}"]
    return f"SELECT unnest(range(0, {len(lines)}))::INT AS place, unnest([{', '.join(lines)}]) AS line FROM events"


@query(_metrics_sql())
def q71_metrics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.operators.metrics import status, status_class

    kind = F.col("event_type")
    when = lambda name, value: F.when(kind == name, value).otherwise(0)
    opened = F.when(kind == "view", 1).when(kind == "click", -1).otherwise(0)
    rows = table(spark, sf_dir, "events").select(status_class(status(kind)).alias("class"), F.when(kind.isin("purchase", "view"), 1).otherwise(0).alias("storage_operations"), when("purchase", F.col("event_id") % 1000).alias("upload_bytes"), when("view", F.col("event_id") % 777).alias("download_bytes"), opened.alias("opened"), (F.col("event_id") % 5000).alias("latency_us"))
    return export_metrics(rows)


def commit_body_error(operations: DataFrame) -> DataFrame:
    """One row: operations, summary and parent of the last header, and the first reason to refuse the body: too many operations, a bad line, or no header.

    operations: place, key, summary, parent, error (of parse_operations, or null), in the body's order.
    """
    header = F.when(F.col("key") == "header", F.struct("place", "summary", "parent"))
    bad = F.when(F.col("error").isNotNull(), F.struct("place", "error"))
    one = operations.agg(F.count("*").alias("operations"), F.max(header).alias("h"), F.min(bad).alias("b"))
    error = F.when(F.col("operations") > COMMIT_OPERATIONS, "too many operations").when(F.col("b").isNotNull(), F.col("b.error")).when(F.col("h").isNull(), "no header")
    return one.select("operations", F.col("h.summary").alias("summary"), F.col("h.parent").alias("parent"), error.alias("error"))


@query(f"""SELECT count(*) AS operations, arg_max(text, (conv_id, turn)) FILTER (role = 'system') AS summary, arg_max(turn::VARCHAR, (conv_id, turn)) FILTER (role = 'system') AS parent,
CASE WHEN count(*) > {COMMIT_OPERATIONS} THEN 'too many operations' WHEN count(*) FILTER (turn > 1000) > 0 THEN 'unknown key' WHEN count(*) FILTER (role = 'system') = 0 THEN 'no header' END AS error FROM conversations""")
def q72_commit_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as one body, system turns being its headers; the last one counts."""
    key = F.when(F.col("role") == "system", "header").otherwise("file")
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("place"), key.alias("key"), F.col("text").alias("summary"), F.col("turn").cast("string").alias("parent"), F.when(F.col("turn") > 1000, "unknown key").alias("error"))
    return commit_body_error(rows)
