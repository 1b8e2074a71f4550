"""Enrichment tables: CVE feeds, their manifests, and the advisory database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import cases, let, struct, text, with_computed
from ..functions.text import choose_cvss
from ..functions.times import parse_published, parse_rfc3339
from ..functions.variants import as_string, elements_of, field, kind, present
from ..schemas import CVE_FEED

# Feed file or folder names, and manifest lines.
FEED_NAME = r"(?:nvdcve-1\.1-|feed=)(\w+)"
MANIFEST_KEYS = ["lastModifiedDate", "size", "gzSize", "sha256"]
MODIFIED_RANK = 9999


def feed_name(path: Column) -> Column:
    return F.regexp_extract(path, FEED_NAME, 1)


def feed_rank(feed: Column) -> Column:
    """Load order of a feed: years ascending, then ``modified``."""
    return F.when(feed == "modified", F.lit(MODIFIED_RANK)).otherwise(feed.try_cast("int"))


def english_text(descriptions: str) -> str:
    """First English description, or an empty text."""
    return f"coalesce(get(filter({descriptions}, d -> d.lang = 'en'), 0).value, '')"


def first_reference_url(references: str) -> str:
    return f"coalesce(get({references}, 0).url, '')"


def parse_feed_documents(documents: DataFrame, document: str = "document") -> DataFrame:
    """Feed documents held as text, opened with the declared schema."""
    kept = [F.col(c) for c in documents.columns if c != document]
    feed = F.from_json(F.col(document), CVE_FEED)
    return documents.select(*kept, feed.getField("CVE_Items").alias("CVE_Items"))


def explode_cve_items(feeds: DataFrame) -> DataFrame:
    """One row per CVE of each feed; ``feed`` tells where it came from."""
    items = feeds.select("feed", F.explode("CVE_Items").alias("item"))
    score = choose_cvss(
        "item.impact.baseMetricV3.cvssV3.baseScore", "item.impact.baseMetricV2.cvssV2.baseScore"
    )
    return items.select(
        F.col("item.cve.CVE_data_meta.ID").alias("cve_id"),
        F.expr(score).alias("cvss"),
        F.expr(english_text("item.cve.description.description_data")).alias("description"),
        F.expr(first_reference_url("item.cve.references.reference_data")).alias("url"),
        F.expr(parse_published("item.publishedDate")).alias("published"),
        "feed",
        feed_rank(F.col("feed")).alias("feed_rank"),
    )


def union_feeds(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed)
    return out


def _pick(items: DataFrame, key: list[str], order: Column, newest: bool) -> DataFrame:
    """One row per key by ``order``; ties fall to the greater remaining columns.

    An aggregate over a struct combines on the map side, so a key that fills a third of
    the rows sends one row per map task instead of all of them to one sort.
    """
    rest = [c for c in items.columns if c not in key]
    packed = F.struct(order.alias("_order"), F.struct(*rest).alias("_row"))
    best = F.max(packed) if newest else F.min(packed)
    return items.groupBy(*key).agg(best.alias("_best")).select(*key, "_best._row.*")


def latest_cve(items: DataFrame) -> DataFrame:
    """One row per CVE: the feed loaded last wins."""
    return _pick(items, ["cve_id"], F.col("feed_rank"), newest=True)


def latest_per_key(items: DataFrame, key: list[str], order: str) -> DataFrame:
    """Newest record of each key."""
    return _pick(items, key, F.col(order), newest=True)


def first_cve_date(items: DataFrame) -> DataFrame:
    """Publication date per CVE: the earliest listed feed wins, ``modified`` comes last."""
    return items.groupBy("cve_id").agg(
        F.min(F.struct("feed_rank", "published")).getField("published").alias("published")
    )


def parse_manifest(t: str) -> str:
    """Manifest fields, each null when its line is missing, and the first missing key."""

    def value(key: str) -> str:
        line = text(key + r":([^\n]*)\r\n")
        return f"if({t} RLIKE {line}, regexp_extract({t}, {line}, 1), NULL)"

    values = {key: value(key) for key in MANIFEST_KEYS}
    error = cases(*[(f"{values[key]} IS NULL", text(key)) for key in MANIFEST_KEYS])
    return struct(
        last_modified=let("t", values["lastModifiedDate"], parse_rfc3339),
        size=f"try_cast({values['size']} AS BIGINT)",
        gz_size=f"try_cast({values['gzSize']} AS BIGINT)",
        sha256=values["sha256"],
        error=error,
    )


def stale_feeds(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Feeds to load again: never loaded, or changed since. Both sides are keyed by ``feed``."""
    joined = manifest.join(state.select("feed", "last_updated"), "feed", "left")
    return joined.filter(
        F.col("last_updated").isNull() | (F.col("last_updated") < F.col("last_modified"))
    )


def changed_version(new_tag: Column, old_tag: Column) -> Column:
    """True when a snapshot is to be taken: no tag is known, or the tag differs."""
    return new_tag.isNull() | ~new_tag.eqNullSafe(old_tag)


def check_feed_hash(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``feed``, ``content``) with ``hash_ok``: upper-case SHA-256 as in the manifest."""
    hashed = files.select("feed", F.upper(F.sha2("content", 256)).alias("computed_sha256"))
    expected = manifest.select("feed", F.col("sha256").alias("expected_sha256"))
    return hashed.join(expected, "feed").withColumn(
        "hash_ok", F.col("computed_sha256") == F.col("expected_sha256")
    )


def check_feed_parts(files: DataFrame, listed: DataFrame) -> DataFrame:
    """A row per part of a feed, on either side, with ``hash_ok``.

    ``files`` has ``feed, part, content``, ``listed`` has ``feed, part, sha256``. A feed in
    parts of bounded size is never one value: each part is hashed where it is read, and only
    hashes are joined. A part without an entry, and an entry without a part, is not ok.
    """
    hashed = files.select("feed", "part", F.upper(F.sha2("content", 256)).alias("computed_sha256"))
    expected = listed.select("feed", "part", F.col("sha256").alias("expected_sha256"))
    joined = hashed.join(expected, ["feed", "part"], "full")
    same = F.coalesce(F.col("computed_sha256") == F.col("expected_sha256"), F.lit(False))
    return joined.withColumn("hash_ok", same)


def check_whole_feeds(parts: DataFrame) -> DataFrame:
    """Feeds of :func:`check_feed_parts` with the hash over their parts' hashes, in order."""
    both = F.struct("part", "computed_sha256", "expected_sha256")
    gathered = parts.groupBy("feed").agg(F.array_sort(F.collect_list(both)).alias("parts"), F.min("hash_ok").alias("hash_ok"))
    over = lambda name: F.upper(F.sha2(F.array_join(F.transform("parts", lambda p: F.coalesce(p[name], F.lit("-"))), ""), 256))
    return gathered.select(
        "feed", F.size("parts").alias("n_parts"), over("computed_sha256").alias("computed_sha256"),
        over("expected_sha256").alias("expected_sha256"), "hash_ok",
    )


def _advisory(value: str) -> str:
    """Typed advisory; null unless all of its fields have the right type."""
    is_text = lambda name: f"{kind(field(value, f'$.{name}'))} = 'string'"
    specs = field(value, "$.specs")
    complete = " AND ".join([
        is_text("advisory"), is_text("id"), is_text("v"), present(field(value, "$.cve")),
        f"{kind(specs)} = 'array'", f"forall({elements_of(specs)}, s -> {kind('s')} = 'string')",
    ])
    cves = f"if({is_text('cve')}, {as_string(value, '$.cve')}, NULL)"
    return f"if({complete}, {struct(id=as_string(value, '$.id'), cve_list=cves)}, NULL)"


def advisory_entries(documents: DataFrame, document: str = "document") -> DataFrame:
    """Entries of the database documents: ``package``, ``advisories`` and the entry's shape.

    The shape is taken from the JSON itself: opening the metadata object as a list would
    yield one advisory of nulls. ``malformed`` is neither a list of advisories nor metadata.
    """
    entries = documents.select(
        F.explode(F.from_json(F.col(document), "map<string,variant>")).alias("package", "entry")
    )
    opened = with_computed(
        entries,
        advisories=f"if({kind('entry')} = 'array', "
        f"transform({elements_of('entry')}, a -> {_advisory('a')}), NULL)",
    )
    meta = (
        f"{kind('entry')} = 'object' AND {kind(field('entry', '$.advisory'))} = 'string' "
        f"AND {present(field('entry', '$.timestamp'))}"
    )
    shape = cases(
        ("forall(advisories, a -> a IS NOT NULL)", "'advisories'"), (meta, "'meta'"),
        other="'malformed'",
    )
    return opened.select("package", "advisories", F.expr(shape).alias("shape"))


def flatten_advisories(documents: DataFrame, document: str = "document") -> DataFrame:
    """(id, cve_list) of every advisory; metadata entries are left out."""
    lists = advisory_entries(documents, document).filter("shape = 'advisories'")
    return lists.select("package", F.explode("advisories").alias("a")).select("package", "a.*")


def dedup_advisories(advisories: DataFrame) -> DataFrame:
    """One row per advisory id. Ids listed twice keep the greater CVE list."""
    return advisories.groupBy("id").agg(F.max("cve_list").alias("cve_list"))
