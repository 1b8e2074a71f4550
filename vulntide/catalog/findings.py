"""Queries: extraction, enrichment tables, enrichment, suppression, notification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF, duck, view
from ..functions.hashing import FINDING_HASH, derived_uuid
from ..functions.text import cvss_text, split_trimmed
from ..functions.urls import normalise_url
from ..operators import dimensions, enrichment, extraction, notification, suppression
from ..plans.pipelines import findings_of
from ..operators.skew import heavy_keys
from ..session import materialise, new_folder, scratch, settled
from ..sinks import writers
from ..sources import readers
from . import oracles as o
from .registry import as_of, cve_table, findings, flat_cvss, flat_error, micros, query, reports

CHANNEL = "security"


def _routed(spark, sf_dir, route):
    return extraction.route_by_tool(reports(spark, sf_dir)).filter(F.col("route") == route)


def _advisories(spark, sf_dir):
    listed = view(spark, sf_dir, "fx_advisories").select("id", "cve_list")
    return materialise(dimensions.dedup_advisories(listed), "advisories")


def _flow(spark, sf_dir):
    return findings_of(
        reports(spark, sf_dir), cve_table(spark, sf_dir), _advisories(spark, sf_dir), as_of()
    )


# Extraction


@query(
    "route_by_tool",
    duck(
        """SELECT event_id, CASE WHEN tool_name = 'bundler-audit' THEN
                    CASE WHEN output_format = 'PlainText' THEN 'bundler' ELSE 'bundler_format' END
                  WHEN tool_name = 'safety' THEN
                    CASE WHEN output_format = 'JSON' THEN 'safety' ELSE 'safety_plain_text' END
                  ELSE 'unknown_tool' END AS route FROM fx_reports"""
    ),
)
def route_by_tool(spark, sf_dir):
    return extraction.route_by_tool(reports(spark, sf_dir)).select("event_id", "route")


@query(
    "block_fields",
    duck(
        "SELECT parent_event_id, CAST(position AS INTEGER) AS position, affected_package, installed_version, "
        "advisory_id, criticality, raw_url AS advisory_url, advisory_description, trim(solution) AS solution FROM fields",
        blocks=o.BLOCKS, fields=o.FIELDS,
    ),
)
def block_fields(spark, sf_dir):
    blocks = extraction.bundler_blocks(_routed(spark, sf_dir, "bundler"))
    rows = blocks.select("parent_event_id", F.posexplode("blocks").alias("position", "b"))
    return rows.select("parent_event_id", "position", "b.*")


_BUNDLER_COLUMNS = (
    f"{o.derived_uuid('concat(parent_event_id, chr(58), position)')} AS event_id, parent_event_id, "
    "application_name, git_branch, git_commit_hash, epoch_us(end_time) AS timestamp, "
    "CAST(position AS INTEGER) AS position, affected_package, installed_version, advisory_id, "
    "advisory_url, advisory_description"
)


def _extracted(df):
    return df.select(
        "event_id", "parent_event_id", "application_name", "git_branch", "git_commit_hash",
        micros("timestamp"), "position", "affected_package", "installed_version", "advisory_id",
        "advisory_url", "advisory_description",
    )


@query(
    "extract_bundler_findings",
    duck(f"SELECT {_BUNDLER_COLUMNS} FROM bundler WHERE NOT failed", **o.BLOCKS_TO_FINDINGS),
)
def extract_bundler_findings(spark, sf_dir):
    return _extracted(extraction.extract_bundler_findings(_routed(spark, sf_dir, "bundler")))


@query(
    "extract_safety_findings",
    duck(
        f"SELECT {_BUNDLER_COLUMNS} FROM (SELECT *, '{o.DB_URL}' AS advisory_url FROM safety_all) s "
        "WHERE failed IS NULL",
        tuples=o.TUPLES, safety_all=o.SAFETY_ALL,
    ),
)
def extract_safety_findings(spark, sf_dir):
    return _extracted(extraction.extract_safety_findings(_routed(spark, sf_dir, "safety")))


@query(
    "emission_order",
    duck(
        "SELECT parent_event_id, position, advisory_id FROM bundler WHERE NOT failed "
        "UNION ALL SELECT parent_event_id, position, advisory_id FROM safety_all WHERE failed IS NULL",
        **o.BLOCKS_TO_FINDINGS, tuples=o.TUPLES, safety_all=o.SAFETY_ALL,
    ),
)
def emission_order(spark, sf_dir):
    """The place of each finding in its report, for both tools."""
    bundler = extraction.extract_bundler_findings(_routed(spark, sf_dir, "bundler"))
    safety = extraction.extract_safety_findings(_routed(spark, sf_dir, "safety"))
    return enrichment.union_findings(bundler, safety).select("parent_event_id", "position", "advisory_id")


@query(
    "explode_batch",
    duck("SELECT event_id, application_name, advisory_id, epoch_us(timestamp) AS timestamp FROM fx_findings"),
)
def explode_batch(spark, sf_dir):
    rows = findings(spark, sf_dir).select("parent_event_id", F.struct(
        "event_id", "application_name", "advisory_id", micros("timestamp")).alias("r"))
    # A report's findings, at most one order's lines, packed into one message.
    messages = rows.groupBy("parent_event_id").agg(F.collect_list("r").alias("records"))
    return extraction.explode_batch(messages)


# Enrichment tables


@query(
    "read_cve_feed",
    duck("SELECT feed, cve_id, epoch_us(published) AS published FROM fx_feed_items"),
)
def read_cve_feed(spark, sf_dir):
    path = new_folder(spark, "feeds")
    documents = view(spark, sf_dir, "fx_feed_documents").select("feed", "document")
    documents.write.partitionBy("feed").option("compression", "gzip").text(path)
    items = dimensions.explode_cve_items(readers.read_cve_feed(spark, path, one_per_line=True))
    return items.select("feed", "cve_id", micros("published"))


_ITEM_COLUMNS = (
    "cve_id, cvss_version, round(CAST(cvss_score AS DOUBLE), 4) AS cvss_score, description, url, "
    "epoch_us(published) AS published"
)


def _items(spark, sf_dir):
    documents = view(spark, sf_dir, "fx_feed_documents").select("feed", "document")
    return dimensions.explode_cve_items(dimensions.parse_feed_documents(documents))


_FEED_TEXT = """
    SELECT feed, cve_id, cvss_version, cvss_score, description, url, published, p_partkey,
           CASE WHEN feed = 'modified' THEN 9999 ELSE CAST(feed AS INTEGER) END AS feed_rank
    FROM fx_feed_items"""


@query("explode_cve_items", duck(f"SELECT feed, feed_rank, {_ITEM_COLUMNS} FROM items", items=_FEED_TEXT))
def explode_cve_items(spark, sf_dir):
    return _items(spark, sf_dir).select(
        "feed", "feed_rank", "cve_id", *flat_cvss(), "description", "url", micros("published")
    )


@query(
    "english_text",
    duck("SELECT feed, cve_id, description, url FROM fx_feed_items"),
)
def english_text(spark, sf_dir):
    return _items(spark, sf_dir).select("feed", "cve_id", "description", "url")


@query(
    "union_feeds",
    duck("SELECT feed, CAST(count(*) AS BIGINT) AS n FROM fx_feed_items GROUP BY feed"),
)
def union_feeds(spark, sf_dir):
    items = _items(spark, sf_dir)
    yearly, modified = items.filter("feed <> 'modified'"), items.filter("feed = 'modified'")
    together = dimensions.union_feeds(yearly, modified)
    return together.groupBy("feed").agg(F.count(F.lit(1)).alias("n"))


_LATEST = f"""SELECT {_ITEM_COLUMNS} FROM
    (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY feed_rank DESC) AS r FROM items) i WHERE r = 1"""


@query("latest_cve", duck(_LATEST, items=_FEED_TEXT))
def latest_cve(spark, sf_dir):
    rows = dimensions.latest_cve(_items(spark, sf_dir))
    return rows.select("cve_id", *flat_cvss(), "description", "url", micros("published"))


@query("latest_per_key", duck(f"SELECT cve_id, published FROM ({_LATEST}) l", items=_FEED_TEXT))
def latest_per_key(spark, sf_dir):
    items = _items(spark, sf_dir).select("cve_id", "feed_rank", "published")
    rows = dimensions.latest_per_key(items, ["cve_id"], "feed_rank")
    return rows.select("cve_id", micros("published"))


@query(
    "first_cve_date",
    duck(
        "SELECT cve_id, epoch_us(arg_min(published, feed_rank)) AS published FROM items GROUP BY cve_id",
        items=_FEED_TEXT,
    ),
)
def first_cve_date(spark, sf_dir):
    return dimensions.first_cve_date(_items(spark, sf_dir)).select("cve_id", micros("published"))


_MANIFEST = """
    SELECT feed,
           CASE WHEN m.last = '' THEN NULL ELSE epoch_us(CAST(m.last AS TIMESTAMPTZ)) END AS last_modified,
           TRY_CAST(m.size AS BIGINT) AS size, TRY_CAST(m.gz AS BIGINT) AS gz_size, m.sha AS sha256,
           CASE WHEN m.gz = '' THEN 'gzSize' END AS error
    FROM (SELECT feed, {'last': regexp_extract(manifest, 'lastModifiedDate:([^\\n]*)\\r\\n', 1),
                        'size': regexp_extract(manifest, 'size:([^\\n]*)\\r\\n', 1),
                        'gz': regexp_extract(manifest, 'gzSize:([^\\n]*)\\r\\n', 1),
                        'sha': regexp_extract(manifest, 'sha256:([^\\n]*)\\r\\n', 1)} AS m
          FROM fx_manifests) t"""


def _manifest(spark, sf_dir):
    path = new_folder(spark, "manifests")
    manifests = view(spark, sf_dir, "fx_manifests").select("feed", F.col("manifest").alias("value"))
    manifests.write.partitionBy("feed").text(path)
    return readers.read_feed_manifest(spark, path)


@query("read_feed_manifest", duck(_MANIFEST))
def read_feed_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).withColumn("last_modified", F.unix_micros("last_modified"))


@query(
    "stale_feeds",
    duck(
        "SELECT feed, m.last_modified FROM manifest m LEFT JOIN fx_feed_state USING (feed) "
        "WHERE last_updated IS NULL OR epoch_us(last_updated) < m.last_modified",
        manifest=_MANIFEST,
    ),
)
def stale_feeds(spark, sf_dir):
    state = view(spark, sf_dir, "fx_feed_state")
    rows = dimensions.stale_feeds(_manifest(spark, sf_dir), state)
    return rows.select("feed", micros("last_modified"))


# Feeds as gzipped parts, each with a manifest of its own. One part in two of 2004 has changed
# since, and 2006 has a part that no manifest lists.
_CHANGED = "feed = '2004' AND chunk % 2 = 1"
_UNLISTED = "feed = '2006' AND chunk = 0"
_PARTS = f"""SELECT feed, chunk AS part,
                    upper(sha256(CASE WHEN {_CHANGED} THEN concat(document, ' ') ELSE document END)) AS computed_sha256,
                    CASE WHEN NOT ({_UNLISTED}) THEN upper(sha256(document)) END AS expected_sha256,
                    NOT ({_CHANGED}) AND NOT ({_UNLISTED}) AS hash_ok
             FROM fx_feed_documents"""


def _feed_parts(spark, sf_dir):
    root = new_folder(spark, "published-feeds")
    parts = materialise(view(spark, sf_dir, "fx_feed_documents").select("feed", "chunk", "document"), "feed-parts")
    content = F.concat("document", F.when(F.expr(_CHANGED), " ").otherwise(""))
    stored = parts.select("feed", F.col("chunk").alias("part"), content.alias("value")).repartition("feed", "part")
    # No line feed behind a document, so that a file holds it and nothing else.
    stored.write.partitionBy("feed", "part").option("compression", "gzip").option("lineSep", "\x00").text(f"{root}/feeds")
    # The other lines of a part's manifest are those of its feed.
    hash_line = F.concat(F.lit("sha256:"), F.upper(F.sha2("document", 256)), F.lit("\r\n"))
    lines = F.concat(F.regexp_replace("manifest", "sha256:.*\r\n", ""), hash_line)
    listed = view(spark, sf_dir, "fx_manifests").join(parts, "feed").where(f"NOT ({_UNLISTED})")
    listed = listed.select("feed", F.col("chunk").alias("part"), lines.alias("value")).repartition("feed", "part")
    listed.write.partitionBy("feed", "part").text(f"{root}/manifests")
    files = readers.read_feed_parts(spark, f"{root}/feeds").withColumn("content", F.rtrim("content", F.lit("\x00")))
    return dimensions.check_feed_parts(files, readers.read_part_manifests(spark, f"{root}/manifests"))


@query("check_feed_hash", duck(_PARTS))
def check_feed_hash(spark, sf_dir):
    return _feed_parts(spark, sf_dir)


@query(
    "check_whole_feeds",
    duck(
        "SELECT feed, CAST(count(*) AS INTEGER) AS n_parts, bool_and(hash_ok) AS hash_ok, "
        "upper(sha256(string_agg(computed_sha256, '' ORDER BY part))) AS computed_sha256, "
        "upper(sha256(string_agg(coalesce(expected_sha256, '-'), '' ORDER BY part))) AS expected_sha256 "
        "FROM parts GROUP BY feed",
        parts=_PARTS,
    ),
)
def check_whole_feeds(spark, sf_dir):
    return dimensions.check_whole_feeds(_feed_parts(spark, sf_dir))


@query(
    "changed_version",
    duck(
        """SELECT a.event_id, a.tag, b.tag AS old_tag, a.tag IS NULL OR a.tag IS DISTINCT FROM b.tag AS changed
           FROM tags a LEFT JOIN tags b ON b.event_id = a.event_id - 1""",
        tags="SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS tag FROM events",
    ),
)
def changed_version(spark, sf_dir):
    tag = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    tags = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", tag.alias("tag"))
    before = tags.select((F.col("event_id") + 1).alias("event_id"), F.col("tag").alias("old_tag"))
    changed = dimensions.changed_version(F.col("tag"), F.col("old_tag"))
    return tags.join(before, "event_id", "left").withColumn("changed", changed)


@query("read_advisory_db", duck("SELECT package, id, cve_list FROM fx_advisories"))
def read_advisory_db(spark, sf_dir):
    path = new_folder(spark, "advisories")
    view(spark, sf_dir, "fx_advisory_documents").select("document").write.text(path)
    return dimensions.flatten_advisories(readers.read_advisory_db(spark, path, whole_files=False))


@query("flatten_advisories", duck("SELECT package, id, cve_list FROM fx_advisories"))
def flatten_advisories(spark, sf_dir):
    return dimensions.flatten_advisories(view(spark, sf_dir, "fx_advisory_documents"))


@query(
    "advisory_entry_shapes",
    duck(
        "SELECT 'advisories' AS shape, CAST(count(*) AS BIGINT) AS n FROM fx_advisories "
        "UNION ALL SELECT 'meta', CAST(count(*) AS BIGINT) FROM fx_advisory_documents"
    ),
)
def advisory_entry_shapes(spark, sf_dir):
    entries = dimensions.advisory_entries(view(spark, sf_dir, "fx_advisory_documents"))
    return entries.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_advisories", duck("SELECT id, cve_list FROM listed", listed=o.LISTED))
def dedup_advisories(spark, sf_dir):
    documents = view(spark, sf_dir, "fx_advisory_documents")
    return dimensions.dedup_advisories(dimensions.flatten_advisories(documents))


# Enrichment


_ENRICHED = """SELECT parent_event_id, CAST(position AS INTEGER) AS position, advisory_id,
                  coalesce(c.cvss_version, 'Unknown') AS cvss_version,
                  round(CAST(c.cvss_score AS DOUBLE), 4) AS cvss_score, advisory_description
           FROM (SELECT * FROM bundler WHERE NOT failed) b
           LEFT JOIN (SELECT cve_id, cvss_version, cvss_score FROM fx_cve) c ON c.cve_id = advisory_id"""


@query("enrich_bundler", duck(_ENRICHED, **o.BLOCKS_TO_FINDINGS))
def enrich_bundler(spark, sf_dir):
    rows = extraction.extract_bundler_findings(_routed(spark, sf_dir, "bundler"))
    rich = enrichment.enrich_bundler(rows, cve_table(spark, sf_dir))
    return rich.select(
        "parent_event_id", "position", "advisory_id", *flat_cvss(), "advisory_description"
    )


@query("enrich_bundler_salted", duck(_ENRICHED, **o.BLOCKS_TO_FINDINGS))
def enrich_bundler_salted(spark, sf_dir):
    """The same, with the heaviest advisories found by a sketch and spread by the plan."""
    rows = materialise(extraction.extract_bundler_findings(_routed(spark, sf_dir, "bundler")), "bundler")
    rich = enrichment.enrich_bundler(rows, cve_table(spark, sf_dir), heavy_keys(rows, "advisory_id"))
    return rich.select(
        "parent_event_id", "position", "advisory_id", *flat_cvss(), "advisory_description"
    )


def _looked_up(spark, sf_dir):
    rows = extraction.extract_safety_findings(_routed(spark, sf_dir, "safety"))
    return enrichment.lookup_advisory(rows, _advisories(spark, sf_dir))


@query(
    "lookup_advisory",
    duck(
        "SELECT parent_event_id, CAST(position AS INTEGER) AS position, advisory_id, advisory_known, cve_list FROM fan",
        tuples=o.TUPLES, safety_all=o.SAFETY_ALL, listed=o.LISTED, fan=o.FAN,
    ),
)
def lookup_advisory(spark, sf_dir):
    return _looked_up(spark, sf_dir).select(
        "parent_event_id", "position", "advisory_id", "advisory_known", "cve_list"
    )


@query(
    "split_cves",
    duck(
        "SELECT parent_event_id, CAST(position AS INTEGER) AS position, "
        "CAST(cve_position AS INTEGER) AS cve_position, cve_id FROM split",
        tuples=o.TUPLES, safety_all=o.SAFETY_ALL, listed=o.LISTED, fan=o.FAN, split=o.SPLIT,
    ),
)
def split_cves(spark, sf_dir):
    return enrichment.split_cves(_looked_up(spark, sf_dir)).select(
        "parent_event_id", "position", "cve_position", "cve_id"
    )


@query(
    "enrich_safety",
    duck(
        """SELECT parent_event_id, CAST(position AS INTEGER) AS position,
                  CAST(cve_position AS INTEGER) AS cve_position, cve_id, cvss_version,
                  round(CAST(cvss_score AS DOUBLE), 4) AS cvss_score, advisory_url, advisory_description
           FROM good_safety""",
        **o.SAFETY,
    ),
)
def enrich_safety(spark, sf_dir):
    rows = extraction.extract_safety_findings(_routed(spark, sf_dir, "safety"))
    rich = enrichment.enrich_safety(rows, _advisories(spark, sf_dir), cve_table(spark, sf_dir))
    return rich.select(
        "parent_event_id", "position", "cve_position", "cve_id", *flat_cvss(),
        "advisory_url", "advisory_description",
    )


_ALL = o.all_findings(AS_OF)
_ALL_COLUMNS = """event_id, parent_event_id, application_name, git_branch, git_commit_hash,
    epoch_us(end_time) AS timestamp, affected_package, installed_version, advisory_id, advisory_url,
    advisory_description, cvss_version, round(CAST(cvss_score AS DOUBLE), 4) AS cvss_score, suppressed,
    CAST(position AS INTEGER) AS position, CAST(cve_position AS INTEGER) AS cve_position, issue_hash"""


def _logged(df):
    return df.select(
        "event_id", "parent_event_id", "application_name", "git_branch", "git_commit_hash",
        micros("timestamp"), "affected_package", "installed_version", "advisory_id", "advisory_url",
        "advisory_description", *flat_cvss(), "suppressed", "position",
        F.coalesce("cve_position", F.lit(0)).alias("cve_position"), "issue_hash",
    )


@query("extract_and_enrich", duck(f"SELECT {_ALL_COLUMNS} FROM flagged", **_ALL))
def extract_and_enrich(spark, sf_dir):
    return _logged(_flow(spark, sf_dir).good)


@query("append_findings", duck(f"SELECT {_ALL_COLUMNS} FROM flagged", **_ALL))
def append_findings(spark, sf_dir):
    path = new_folder(spark, "findings")
    with scratch(spark):
        rows = settled(spark, "findings", lambda: _flow(spark, sf_dir).good)
        writers.append_findings(rows, path, batch_id=0)
    return _logged(writers.read_table(spark, path))


@query(
    "union_findings",
    duck(
        "SELECT application_name, advisory_id LIKE '%-%' AS from_bundler, CAST(count(*) AS BIGINT) AS n "
        "FROM flagged GROUP BY application_name, advisory_id LIKE '%-%'",
        **_ALL,
    ),
)
def union_findings(spark, sf_dir):
    good = _flow(spark, sf_dir).good
    rows = good.withColumn("from_bundler", F.col("advisory_id").contains("-"))
    return rows.groupBy("application_name", "from_bundler").agg(F.count(F.lit(1)).alias("n"))


_BAD = {
    "routes": """
        SELECT event_id AS parent_event_id, CASE WHEN tool_name = 'other-tool' THEN 'unknown_tool'
               WHEN tool_name = 'safety' THEN 'safety_plain_text' ELSE 'bundler_format' END AS name
        FROM fx_reports WHERE tool_name = 'other-tool'
           OR (tool_name = 'safety') <> (output_format = 'JSON')""",
    "bad": """
        SELECT parent_event_id, name FROM routes
        UNION ALL SELECT DISTINCT parent_event_id, 'advisory_description_empty' FROM bundler WHERE failed
        UNION ALL SELECT DISTINCT parent_event_id, failed FROM safety_all WHERE failed IS NOT NULL
        UNION ALL SELECT parent_event_id, arg_min(failed, row(position, cve_position)) FROM enriched
                  WHERE failed IS NOT NULL GROUP BY parent_event_id""",
}


@query(
    "rejected_extractions",
    duck(
        "SELECT parent_event_id, error_code, error_message, json_field_name FROM bad JOIN errors USING (name)",
        **o.BLOCKS_TO_FINDINGS, **o.SAFETY, **_BAD, errors=o.error_list(),
    ),
)
def rejected_extractions(spark, sf_dir):
    return _flow(spark, sf_dir).bad.select("parent_event_id", *flat_error())


# Hashes, ids and texts of findings


@query(
    "issue_hash",
    duck(
        f"SELECT event_id, {o.issue_hash()} AS issue_hash, "
        f"{o.derived_uuid('concat(parent_event_id, chr(58), advisory_id)')} AS new_id FROM fx_findings"
    ),
)
def issue_hash(spark, sf_dir):
    new_id = F.expr(derived_uuid("parent_event_id", "advisory_id"))
    return findings(spark, sf_dir).select(
        "event_id", F.expr(FINDING_HASH).alias("issue_hash"), new_id.alias("new_id")
    )


_SCORE = (
    "CASE WHEN cvss_version = 'Unknown' THEN 'Unknown' ELSE concat(cvss_version, '(', "
    "regexp_replace(CAST(cvss_score AS VARCHAR), '\\.0$', ''), ')') END"
)


@query("cvss_text", duck(f"SELECT event_id, {_SCORE} AS cvss_text FROM fx_findings"))
def cvss_text_query(spark, sf_dir):
    return findings(spark, sf_dir).select("event_id", F.expr(cvss_text("cvss")).alias("cvss_text"))


# Twelve ways to write the address of a page; the last seven have their normal form beside them.
_ORIGIN = "regexp_extract(url, '^https?://[^/]+')"
_NAME = "regexp_extract(url, '^https?://([^/]+)', 1)"
_URL_PARTS = "regexp_extract(text, '^([a-zA-Z]+)://([^/?#]+)(.*)$', {})"


@query(
    "normalise_url",
    duck(
        f"""SELECT page_id, CASE page_id % 12
                  WHEN 5 THEN {_ORIGIN} || '/y/p' || page_id
                  WHEN 6 THEN 'http://' || ((page_id * 65537) // 16777216 % 256) || '.' || ((page_id * 65537) // 65536 % 256)
                              || '.' || ((page_id * 65537) // 256 % 256) || '.' || ((page_id * 65537) % 256) || '/'
                  WHEN 7 THEN 'http://192.' || (page_id % 256) || '.' || ((page_id % 65536) // 256) || '.' || (page_id % 256) || '/'
                  WHEN 8 THEN 'https://xn--bcher-kva.example/%C3%A9' || page_id
                  WHEN 9 THEN 'http://[2001:db8::' || CASE WHEN page_id % 65536 = 0 THEN '' ELSE lower(to_hex(page_id % 65536)) END || ']/'
                  WHEN 10 THEN NULL
                  WHEN 11 THEN 'ftp://u%20ser:p%40ss@' || {_NAME} || '/a%22b%60%7B' || page_id || '%7D?q=%27' || page_id
                  ELSE CASE WHEN parts[1] = '' THEN NULL ELSE concat(lower(parts[1]), '://', lower(parts[2]),
                       CASE WHEN parts[3] = '' THEN '/' ELSE replace(parts[3], ' ', '%20') END) END END AS normal
           FROM (SELECT page_id, url, [{_URL_PARTS.format(1)}, {_URL_PARTS.format(2)}, {_URL_PARTS.format(3)}] AS parts
                 FROM (SELECT page_id, url, CASE page_id % 12 WHEN 0 THEN replace(url, 'http', 'HTTP')
                         WHEN 1 THEN concat({_ORIGIN}, '/a b') WHEN 2 THEN upper({_ORIGIN})
                         WHEN 3 THEN 'not a url' ELSE url END AS text FROM pages) u) p"""
    ),
)
def normalise_url_query(spark, sf_dir):
    url, page, kind = F.col("url"), F.col("page_id"), F.col("page_id") % 12
    origin, name = (F.regexp_extract(url, "^(https?://([^/]+))", k) for k in (1, 2))
    text = (
        F.when(kind == 0, F.replace(url, F.lit("http"), F.lit("HTTP")))
        .when(kind == 1, F.concat(origin, F.lit("/a b")))
        .when(kind == 2, F.upper(origin))
        .when(kind == 3, F.lit("not a url"))
        .when(kind == 5, F.concat(origin, F.lit("/x/../y/./z/%2E%2e/p"), page))
        .when(kind == 6, F.concat(F.lit("http://"), page * 65537 % (1 << 32)))
        .when(kind == 7, F.concat(F.lit("http://0300."), page % 256, F.lit("."), page % 65536))
        .when(kind == 8, F.concat(F.lit("https://B\u00dcCHER.Example/\u00e9"), page))
        .when(kind == 9, F.concat(F.lit("http://[2001:DB8:0:0:0:0:0:"), F.hex(page % 65536), F.lit("]")))
        .when(kind == 10, F.concat(F.lit("http://256.1.2."), page))
        .when(kind == 11, F.concat(F.lit("ftp://u ser:p@ss@"), name, F.lit(":021/a\"b`{"), page, F.lit("}?q='"), page))
        .otherwise(url)
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.alias("text")).selectExpr(
        "page_id", f"{normalise_url('text')} AS normal"
    )


@query(
    "split_and_trim",
    duck(
        "SELECT id, package, array_to_string(list_transform(string_split(cve_list, ','), lambda x: trim(x)), '|') AS cves "
        "FROM fx_advisories WHERE cve_list IS NOT NULL"
    ),
)
def split_and_trim(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_advisories").filter("cve_list IS NOT NULL")
    return rows.selectExpr("id", "package", f"array_join({split_trimmed('cve_list')}, '|') AS cves")


# Suppression


@query(
    "apply_suppressions",
    duck(
        "SELECT event_id, CAST(cve_position AS INTEGER) AS cve_position, issue_hash, suppressed FROM flagged",
        **_ALL,
    ),
)
def apply_suppressions(spark, sf_dir):
    cve_position = F.coalesce("cve_position", F.lit(0)).alias("cve_position")
    return _flow(spark, sf_dir).good.select("event_id", cve_position, "issue_hash", "suppressed")


_LIVE = f"""SELECT DISTINCT application_name, issue_hash FROM fx_suppressions
            WHERE expiry_date IS NULL OR expiry_date > TIMESTAMP '{AS_OF}'"""
_HASHED = f"SELECT f.*, {o.issue_hash()} AS issue_hash FROM fx_findings f"


def _suppressions(spark, sf_dir):
    return view(spark, sf_dir, "fx_suppressions")


@query(
    "suppressed_by_table",
    duck("SELECT event_id, issue_hash FROM hashed SEMI JOIN live USING (application_name, issue_hash)",
         live=_LIVE, hashed=_HASHED),
)
def suppressed_by_table(spark, sf_dir):
    rows = suppression.suppressed_by_table(
        findings(spark, sf_dir), _suppressions(spark, sf_dir), as_of()
    )
    return rows.select("event_id", "issue_hash")


@query(
    "unsuppressed_by_table",
    duck("SELECT event_id, issue_hash FROM hashed ANTI JOIN live USING (application_name, issue_hash)",
         live=_LIVE, hashed=_HASHED),
)
def unsuppressed_by_table(spark, sf_dir):
    rows = suppression.unsuppressed_by_table(
        findings(spark, sf_dir), _suppressions(spark, sf_dir), as_of()
    )
    return rows.select("event_id", "issue_hash")


@query(
    "any_live_match",
    duck(
        f"""SELECT application_name, issue_hash,
                   bool_or(expiry_date IS NULL OR expiry_date > TIMESTAMP '{AS_OF}') AS live
            FROM fx_suppressions GROUP BY application_name, issue_hash"""
    ),
)
def any_live_match(spark, sf_dir):
    rows = _suppressions(spark, sf_dir)
    live = F.bool_or(suppression.live(F.col("expiry_date"), as_of()))
    return rows.groupBy("application_name", "issue_hash").agg(live.alias("live"))


@query("unsuppressed", duck("SELECT event_id FROM fx_findings WHERE NOT suppressed"))
def unsuppressed(spark, sf_dir):
    return suppression.unsuppressed(findings(spark, sf_dir)).select("event_id")


# Notification

_MESSAGE = f"""concat('Vulnerable package found in: ', application_name, chr(10),
    'What package is affected? ', affected_package, ' ', installed_version, chr(10),
    'Where was this found? Commit ', git_commit_hash, ' on branch ', coalesce(git_branch, 'Not Provided'), chr(10),
    'What is the problem? ', advisory_description, chr(10),
    'How serious is it? CVSS ', {_SCORE}, chr(10),
    'Where can I find out more? ', advisory_url, chr(10),
    'Issue hash if this should be suppressed: ', {o.issue_hash()})"""


@query("render_notification", duck(f"SELECT event_id, {_MESSAGE} AS text FROM fx_findings"))
def render_notification(spark, sf_dir):
    return findings(spark, sf_dir).select("event_id", F.expr(notification.message_text()).alias("text"))


@query(
    "append_outbox",
    duck(
        f"SELECT '{CHANNEL}' AS channel, event_id, {_MESSAGE} AS text FROM fx_findings WHERE NOT suppressed"
    ),
)
def append_outbox(spark, sf_dir):
    path = new_folder(spark, "outbox")
    writers.append_outbox(notification.outbox(findings(spark, sf_dir), CHANNEL), path, batch_id=0)
    return writers.read_table(spark, path).select("channel", "event_id", "text")
