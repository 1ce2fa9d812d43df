"""The media library as the user sees it: unions, first-seen rows, tags, dates, paging, selections, people lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.functions.text import (
    RECENT,
    basename,
    photo_person_name,
    prefixed_id,
    slashes,
    tags,
    video_person_name,
)
from reelgraph.operators.ranking import with_row_number

TOP_TAGS = 14
MAX_EXPORT = 25
COLUMNS = 5

PAGE_ROWS = 10_000  # a page that ends before is cut from the first rows in order
RANGES = 64  # ranges in which rows are counted for a page further in


def first_per_key(df: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """First row of each non-empty key in ``order``.

    Written as an aggregate, not a row number: each task keeps one row per key, so a key that fills a third of the
    table costs one row per task in the shuffle.
    """
    named = df.withColumn("_key", F.col(key) if isinstance(key, str) else key)
    row = F.struct(*df.columns)
    place = F.struct(*order)
    firsts = named.filter(F.col("_key").isNotNull() & (F.col("_key") != "")).groupBy("_key").agg(
        F.min_by(row, place).alias("_row")
    )
    return firsts.select("_row.*")


def combined_media(photos: DataFrame, videos: DataFrame, library_filter: str = "all") -> DataFrame:
    """Photos, then videos, with their media type; the first row of every path (or id) stays.

    Both sides carry ``seq``, their order in their own list.
    """
    parts = []
    if library_filter in ("all", "photos"):
        parts.append(photos.withColumns({"media_type": F.lit("photo"), "_side": F.lit(0)}))
    if library_filter in ("all", "videos"):
        parts.append(videos.withColumns({"media_type": F.lit("video"), "_side": F.lit(1)}))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    keys = [F.when(F.col(c) != "", F.col(c)) for c in ("path", "id", "src") if c in both.columns]
    return first_per_key(both, slashes(F.coalesce(*keys)), "_side", "seq").drop("_side")


def person_media(media: DataFrame, person_paths: DataFrame, kind: str = "photo") -> DataFrame:
    """Items of one person: full path, file name, id or uploaded_videos/name is among the person's paths."""
    path = slashes(F.col("path"))
    variants = [path, basename(path)]
    if kind == "video":
        variants.append(F.concat(F.lit("uploaded_videos/"), basename(path)))
    wanted = person_paths.select(F.explode(F.array(*variants)).alias("_key")).distinct()
    item = slashes(F.coalesce("path", "id"))
    name = basename(item)
    keys = F.array(item, name, F.col("id"), F.concat(F.lit("uploaded_videos/"), name))
    hits = media.select("id", F.explode(F.array_distinct(keys)).alias("_key")).join(wanted, "_key", "left_semi")
    return media.join(hits.select("id").distinct(), "id", "left_semi")


def tag_counts(videos: DataFrame, limit: int | None = TOP_TAGS) -> DataFrame:
    """(tag, n) by falling count, then tag; the first ``limit`` or all."""
    counts = videos.select(F.explode(tags(F.col("label"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.col("n").desc(), "tag")
    return ordered if limit is None else ordered.limit(limit)


def with_tag(videos: DataFrame, tag: str) -> DataFrame:
    return videos if tag == "all" else videos.filter(F.array_contains(tags(F.col("label")), tag))


def by_date(media: DataFrame, date: str = "date") -> DataFrame:
    """(date, n): items per date, newest first; items without a date are Recent, which comes first."""
    dated = media.groupBy(F.coalesce(date, F.lit(RECENT)).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return dated.orderBy(F.col("date").desc())


def grid_rows(media: DataFrame, columns: int = COLUMNS, *, date: str = "date", order: str = "seq") -> DataFrame:
    """``media`` with the grid row and column of each item inside its date.

    The position inside a date comes from positions over the whole table, so a date with a third of all items is
    not one task.
    """
    dated = media.withColumn("date", F.coalesce(date, F.lit(RECENT)))
    placed = with_row_number(dated.select("date", order), "date", order, name="_rn")
    start = placed.groupBy("date").agg(F.min("_rn").alias("_first"))
    offset = F.col("_rn") - F.col("_first")
    return dated.join(placed.join(start, "date"), ["date", order]).select(
        *media.columns if "date" in media.columns else [*media.columns, "date"],
        F.floor(offset / columns).cast("long").alias("row"), (offset % columns).cast("long").alias("col"),
    )


def page(df: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """One page of an ordered list (end the order on a unique key); the total is a separate ``count``.

    A page that ends within ``PAGE_ROWS`` rows is a top-k. For one further in, rows are counted in ranges of the order and
    only the ranges that hold the page are looked at, again until it begins early in them: nothing is sorted as a whole.
    """
    rows, skip = df, offset
    while skip + limit > PAGE_ROWS:
        nearer = _ranges_of_page(rows, skip, limit, order)
        if nearer is None:
            break
        rows, skip = nearer
    return rows.orderBy(*order).offset(skip).limit(limit)


def _ranges_of_page(rows: DataFrame, skip: int, limit: int, order: tuple[str, ...]) -> tuple[DataFrame, int] | None:
    """Rows of the ranges that hold the page and what is left to skip in them; None where that is over half of all.

    The borders are the keys of least hash: few, spread as the keys are, and the same whenever they are drawn.
    """
    drawn = rows.select(*order).orderBy(F.xxhash64(*order)).limit(RANGES).toArrow()
    if drawn.num_rows == 0:
        return None
    borders = rows.sparkSession.createDataFrame(drawn).agg(F.array_sort(F.collect_list(F.struct(*order)))).scalar()
    below = [(F.element_at(borders, k + 1) < F.struct(*order)).cast("int") for k in range(drawn.num_rows)]
    ranged = rows.withColumn("__range", sum(below[1:], below[0]))
    counts = dict(ranged.groupBy("__range").count().collect())  # at most one row a border
    start, kept, before = 0, [], 0
    for place, n in sorted(counts.items()):
        if start + n > skip and start < skip + limit:
            before = before if kept else start
            kept.append(place)
        start += n
    if 2 * sum(counts[k] for k in kept) > start:
        return None
    return ranged.filter(F.col("__range").isin(kept)).drop("__range"), max(0, skip - before)


def nth_by_id(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return page(df, n, 1, id_col)


def select_range(items: DataFrame, start_id, end_id, *, id_col: str = "id", order: str = "seq") -> DataFrame:
    """Items between two ids in list order, both included, whichever comes first; nothing when one is absent."""
    found = F.countDistinct(id_col) == (1 if start_id == end_id else 2)
    ends = items.filter(F.col(id_col).isin(start_id, end_id)).agg(
        F.when(found, F.struct(F.min(order).alias("lo"), F.max(order).alias("hi")))
    )
    bounds = ends.scalar()
    return items.filter(F.col(order).between(bounds["lo"], bounds["hi"]))


def export_selection(items: DataFrame, selected: DataFrame, limit: int = MAX_EXPORT) -> DataFrame:
    """The first 25 selected items that exist and have a source, in selection order (``sel_ord``)."""
    chosen = items.filter(F.col("src").isNotNull() & (F.col("src") != "")).join(selected, "id")
    return chosen.orderBy("sel_ord").limit(limit)


def without(items: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """All rows but the removed keys; duplicates of the others stay."""
    return items.join(removed.select(key), key, "left_anti")


def media_counts(results: DataFrame) -> DataFrame:
    """Photos and videos among search results; "image" counts as photo."""
    photo = F.col("media_type").isin("photo", "image")
    return results.agg(
        F.count_if(photo).alias("photos"), F.count_if(F.col("media_type") == "video").alias("videos")
    )


def merged_results(photos: DataFrame, videos: DataFrame, kind: str = "all") -> DataFrame:
    """Photo and video search results by falling score, optionally one kind only."""
    tagged = photos.withColumn("media_type", F.lit("photo")).unionByName(
        videos.withColumn("media_type", F.lit("video")), allowMissingColumns=True
    )
    if kind != "all":
        tagged = tagged.filter(F.col("media_type") == {"photos": "photo", "videos": "video"}[kind])
    return tagged.orderBy("query_id", F.col("score").desc(), "media_type", "id")


def people_summary(people: DataFrame, person_photos: DataFrame, live: DataFrame) -> DataFrame:
    """(person_id, name, photo_count, preview_photo) of people with live photos, most photos first."""
    counted = (
        person_photos.join(live.select("path"), "path", "left_semi")
        .groupBy("person_id")
        .agg(F.count(F.lit(1)).alias("photo_count"), F.min_by("path", "seq").alias("preview_photo"))
    )
    named = counted.join(people, "person_id").select(
        "person_id", photo_person_name(F.col("name"), F.col("person_id")).alias("name"), "photo_count", "preview_photo"
    )
    return named.orderBy(F.col("photo_count").desc(), "person_id")


def live_person_photos(person_photos: DataFrame, live: DataFrame, person_id: str) -> DataFrame:
    mine = person_photos.filter(F.col("person_id") == person_id)
    return mine.join(live.select("path"), "path", "left_semi").orderBy("seq")


def people_page(photo_people: DataFrame, video_people: DataFrame, page_no: int, page_size: int) -> DataFrame:
    """One page of the people list: photo people are paged, video people come once, on the first page."""
    ordered = photo_people.withColumn("_fewer", -F.col("photo_count"))
    photos = page(ordered, page_no * page_size, page_size, "_fewer", "person_id")
    photos = photos.select(
        prefixed_id("photo", F.col("person_id")).alias("id"), F.lit("photo").alias("source"), "name",
        F.col("photo_count").cast("long").alias("n"),
    )
    if page_no:
        return photos
    videos = video_people.select(
        prefixed_id("video", F.col("id")).alias("id"), F.lit("video").alias("source"),
        video_person_name(F.col("name"), F.col("id")).alias("name"), F.col("n").cast("long").alias("n"),
    )
    return photos.unionByName(videos)


def people_total(photo_people: DataFrame, video_people: DataFrame) -> DataFrame:
    ids = photo_people.select(F.lit(1)).union(video_people.select(F.lit(1)))
    return ids.agg(F.count(F.lit(1)).alias("total"))


def cached_live_unindexed(cached: DataFrame, live: DataFrame, indexed: DataFrame) -> DataFrame:
    """Cached paths that are still there and not indexed."""
    return cached.join(live.select("path"), "path", "left_semi").join(indexed.select("path"), "path", "left_anti")
