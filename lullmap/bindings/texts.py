"""Names, addresses and text output."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullmap.bindings.common import query, table
from lullmap.operators import text

CANONICAL = r"""c AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
k AS (SELECT page_id, url, lower(p.scheme) || '://' || lower(p.host) || CASE WHEN rtrim(p.path, '/') = '' THEN '/' ELSE rtrim(p.path, '/') END
  || CASE WHEN p.query <> '' THEN '?q=' || left(sha1(p.query), 12) ELSE '' END AS url_key FROM c)"""


@query("canonical_url", f"WITH {CANONICAL} SELECT page_id, url_key FROM k")
def canonical_url(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return text.with_canonical_url(pages, "url").select("page_id", "url_key")


@query(
    "dedupe_by_url",
    f"""WITH {CANONICAL} SELECT url_key, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM k GROUP BY url_key""",
)
def dedupe_by_url(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return text.dedupe_by_url(pages, "url", ["page_id"])


@query(
    "redact_pages",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^(https?://)', '<redacted>@'), '\?[^#]*', '?<redacted>'), '#.*', '#<redacted>') AS url,
    1 + (url LIKE '%?%')::INTEGER + (url LIKE '%#%')::INTEGER AS hits FROM pages""",
)
def redact_pages(spark, sf):
    """Addresses with credentials put in front of the host, inside a sentence.

    The second sweep, for bare credentials, then takes the masked ones with their scheme.
    """
    secret = F.regexp_replace("url", "^(https?://)", "$1user:se@cret@")
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("see "), secret, F.lit(" now")).alias("url"))
    clean = text.redact(pages, "url")
    return clean.withColumn("url", F.regexp_extract("url", "^see (.*) now$", 1))


@query(
    "redact_documents",
    r"""SELECT doc_id, regexp_replace(text, '(?i)\b[\w.\-]+:[^\s"]*@([\w.\-]+(?::\d+)?)', '<redacted>@\1', 'g') AS text,
    len(regexp_extract_all(text, '(?i)\b[\w.\-]+:[^\s"]*@[\w.\-]+(?::\d+)?'))::INTEGER AS hits FROM documents""",
)
def redact_documents(spark, sf):
    """Every whole text as it is, masked and counted; the tables hold no address with a scheme, ``redact_texts`` adds some."""
    return text.redact(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query(
    "redact_texts",
    """SELECT doc_id, text || ' GET <redacted>@h' || doc_id || '.org:8443/a?<redacted>#<redacted> or "ftp://h.org/x#<redacted>" via <redacted>@proxy:1080 end' AS text,
    5 AS hits FROM documents""",
)
def redact_texts(spark, sf):
    """Whole documents with addresses and credentials added, masked and counted."""
    number = F.col("doc_id").cast("string")
    leak = F.concat(
        F.lit(" GET https://me:p@w@H"), number, F.lit(".org:8443/a?sig="), number,
        F.lit('#t or "ftp://h.org/x#f" via user:pa@ss@proxy:1080 end'),
    )
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", leak).alias("text"))
    return text.redact(docs, "text")


PART_KEY = r"""p AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 = 0 THEN '!' WHEN p_partkey % 4 = 1 THEN '-' || (1700000000 + p_partkey)
    WHEN p_partkey % 4 = 2 THEN '-1700000000-0a1b2c3d' ELSE '' END AS name, 'Site ' || p_brand AS site FROM part),
q AS (SELECT *, regexp_replace(name, '-\d{10}(-[0-9a-f]{8})?$', '') AS stem FROM p),
r AS (SELECT *, regexp_replace(regexp_replace(lower(stem), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS safe,
  regexp_replace(lower(site), '[^A-Za-z0-9._-]+', '_', 'g') AS s FROM q),
i AS (SELECT *, s || '_' || left(sha1(lower(site)), 8) || '_' || safe || CASE WHEN safe <> stem THEN '_' || left(sha1(stem), 8) ELSE '' END AS identity FROM r)"""


def named_parts(spark, sf):
    key = F.col("p_partkey")
    tail = (
        F.when(key % 4 == 0, F.lit("!"))
        .when(key % 4 == 1, F.concat(F.lit("-"), (key + 1_700_000_000).cast("string")))
        .when(key % 4 == 2, F.lit("-1700000000-0a1b2c3d"))
        .otherwise(F.lit(""))
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat("p_name", tail).alias("name"),
        F.concat(F.lit("Site "), "p_brand").alias("site"),
    )


@query("identity_key", f"WITH {PART_KEY} SELECT p_partkey, name, site, identity FROM i")
def identity_key(spark, sf):
    return text.with_identity(named_parts(spark, sf), "name", "site")


@query(
    "identity_collisions",
    f"""WITH {PART_KEY}, d AS (SELECT DISTINCT site, name, identity FROM i)
    SELECT identity, count(*) AS names, min(name) AS first_name, max(name) AS last_name FROM d GROUP BY identity HAVING count(*) > 1""",
)
def identity_collisions(spark, sf):
    return text.identity_collisions(named_parts(spark, sf), "name", "site")


@query(
    "artifact_keys",
    """WITH p AS (SELECT p_partkey, '/data/' || p_type || '/' || replace(p_name, ' ', '-') || '-1700000001.mp4' AS path FROM part)
    SELECT p_partkey, path, replace(regexp_extract(path, '([^/]*)-1700000001.mp4$', 1), ' ', '_') || '_' || left(sha256(path), 8) AS artifact FROM p""",
)
def artifact_keys(spark, sf):
    path = F.concat(
        F.lit("/data/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-1700000001.mp4")
    )
    return text.artifact_keys(table(spark, sf, "part").select("p_partkey", path.alias("path")), "path")


CLASS = """CASE WHEN lower(text) LIKE '%the th%' THEN 'first' WHEN lower(text) LIKE '%lic%' OR lower(text) LIKE '%err%' THEN 'second' ELSE 'generic' END"""
RULES = (("first", ("the th",)), ("second", ("lic", "err")))


@query(
    "classify_text",
    f"""SELECT doc_id, {CLASS} AS failure, CASE WHEN {CLASS} = 'generic' THEN CASE WHEN text = '' THEN 'unknown error' ELSE text END END AS message
    FROM documents""",
)
def classify_text(spark, sf):
    """Documents by marker rules of their own."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text.with_failure_class(docs, "text", rules=RULES).select("doc_id", "failure", "message")


MARKED = """d AS (SELECT doc_id, lang, CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN -9 WHEN 2 THEN 137 WHEN 3 THEN NULL ELSE 1 END AS code,
  text || CASE doc_id % 9 WHEN 0 THEN ' Video unavailable' WHEN 1 THEN ' No space left on device' WHEN 2 THEN ' Errno 16' WHEN 3 THEN ' Permission denied'
    WHEN 4 THEN ' malloc failed' ELSE '' END AS text FROM documents)"""


@query(
    "failure_breakdown",
    f"""WITH {MARKED}, c AS (SELECT lang, CASE WHEN code <> 0 AND (code IN (-9, 137) OR regexp_matches(lower(text),
        'out of memory|cannot allocate memory|malloc failed|mmap failed|not enough space|error splitting input into thread')) THEN 'out_of_memory'
      WHEN regexp_matches(lower(text), 'video unavailable|this video is unavailable|this video is no longer available|video is private|has been removed') THEN 'unavailable'
      WHEN regexp_matches(lower(text), 'no space left|disk full|errno 28') THEN 'disk'
      WHEN regexp_matches(lower(text), 'winerror 32|being used by another process|resource busy|errno 16') THEN 'busy'
      WHEN regexp_matches(lower(text), 'permission denied|errno 13') THEN 'permission' ELSE 'generic' END AS failure FROM d)
    SELECT lang, failure, count(*) AS runs FROM c GROUP BY 1, 2""",
)
def failure_breakdown(spark, sf):
    """Documents as the output of runs, with an exit code each."""
    n = F.col("doc_id")
    code = F.when(n % 8 == 0, 0).when(n % 8 == 1, -9).when(n % 8 == 2, 137).when(n % 8 != 3, 1)
    tail = (
        F.when(n % 9 == 0, F.lit(" Video unavailable"))
        .when(n % 9 == 1, F.lit(" No space left on device"))
        .when(n % 9 == 2, F.lit(" Errno 16"))
        .when(n % 9 == 3, F.lit(" Permission denied"))
        .when(n % 9 == 4, F.lit(" malloc failed"))
        .otherwise(F.lit(""))
    )
    runs = table(spark, sf, "documents").select("lang", code.alias("code"), F.concat("text", tail).alias("text"))
    return text.failure_breakdown(runs, "text", "code", ["lang"])


@query(
    "listing_urls",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'youtube_channel' WHEN 1 THEN 'twitch_channel' WHEN 2 THEN 'youtube_playlist' ELSE 'youtube_channel' END AS family,
      CASE page_id % 5 WHEN 0 THEN '@user' || page_id WHEN 1 THEN 'user' || page_id WHEN 2 THEN 'PL00000000' || page_id ELSE 'c/user' || page_id END AS name,
      CASE page_id % 5 WHEN 0 THEN 'streams' WHEN 1 THEN 'archives' ELSE 'videos' END AS tab FROM pages WHERE page_id % 5 < 4""",
)
def listing_urls(spark, sf):
    """Page ids turned into the address families, and one that is none."""
    n, i = F.col("page_id"), F.col("page_id").cast("string")
    put = lambda before, after: F.concat(F.lit(before), i, F.lit(after))
    url = (
        F.when(n % 5 == 0, put("https://www.youtube.com/@user", "/Streams?x=1"))
        .when(n % 5 == 1, put("https://m.twitch.tv/user", "/videos?filter=all"))
        .when(n % 5 == 2, put("https://youtube.com/watch?v=abc&list=PL00000000", ""))
        .when(n % 5 == 3, put("HTTPS://m.YouTube.com/c/user", ""))
        .otherwise(F.col("url"))
    )
    pages = table(spark, sf, "pages").select("page_id", url.alias("address"))
    return text.listing_urls(pages, "address").drop("address")
