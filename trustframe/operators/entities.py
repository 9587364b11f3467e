"""Entity directory: duplicates, nearest centre, one-to-one matching, normalisation, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import classify, dates, fingerprints, geo, text
from trustframe.operators.blocks import in_blocks, same_blocks
from trustframe.operators.ranking import join_back, occurrence_number
from trustframe.session import cut_lineage, spread

MAX_LITERAL_CENTRES = 1000


def _axes(lat: Column, lng: Column) -> list[Column]:
    """Cartesian metres: a grid on them is exact at the poles and across the date line."""
    flat = F.cos(F.radians(lat))
    return [
        flat * F.cos(F.radians(lng)) * geo.EARTH_M,
        flat * F.sin(F.radians(lng)) * geo.EARTH_M,
        F.sin(F.radians(lat)) * geo.EARTH_M,
    ]


def _close_pairs(sites: DataFrame, key: str, radius_m: float) -> DataFrame:
    """Pairs of sites with an equal key within the radius; only neighbouring grid cells are compared.

    Full cells are cut into blocks. Chords are no longer than arcs, so that most pairs need no arc.
    """
    size, reach = 4.0 * radius_m, radius_m * 1.001 + 0.01
    names, places = ("cx", "cy", "cz"), ("px", "py", "pz")
    sites = spread(sites).withColumns(dict(zip(places, _axes(F.col("lat"), F.col("lng")))))
    home = sites.select("*", *[F.floor(F.col(p) / size).alias(n) for p, n in zip(places, names)])
    around = sites
    for p, n in zip(places, names):
        around = around.withColumn(n, F.explode(F.sequence(F.floor((F.col(p) - reach) / size), F.floor((F.col(p) + reach) / size))))
    a, b = in_blocks(around, home, [key, *names], [key, *names], ["site_id"], ["site_id"])
    cond = F.col(f"a.{key}") == F.col(f"b.{key}")
    for n in names:
        cond = cond & (F.col(f"a.{n}") == F.col(f"b.{n}"))
    chord = sum(((F.col(f"a.{p}") - F.col(f"b.{p}")) * (F.col(f"a.{p}") - F.col(f"b.{p}")) for p in places), F.lit(0.0))
    cond = cond & same_blocks() & (F.col("a.site_id") < F.col("b.site_id")) & (chord <= reach * reach)
    far = geo.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return a.join(b, cond).withColumn("distance", far).filter(F.col("distance") <= radius_m)


def _sites(df: DataFrame) -> DataFrame:
    return df.groupBy("name_key", "contact_key", "lat", "lng").agg(
        F.min("id").alias("site_id"), F.count(F.lit(1)).alias("site_rows")
    )


def _site_pairs(sites: DataFrame, radius_m: float) -> DataFrame:
    has_contact = F.col("a.contact_key") != ""
    same_contact = has_contact & (F.col("a.contact_key") == F.col("b.contact_key"))
    by_name = _close_pairs(sites, "name_key", radius_m).withColumn(
        "reason", F.when(same_contact, F.lit("same-name-and-contact")).otherwise(F.lit("same-name"))
    )
    reachable = sites.filter(F.col("contact_key") != "")
    by_contact = (
        _close_pairs(reachable, "contact_key", radius_m)
        .filter(~F.col("a.name_key").eqNullSafe(F.col("b.name_key")))
        .withColumn("reason", F.lit("same-contact"))
    )
    columns = [
        F.col("a.site_id").alias("first_id"), F.col("b.site_id").alias("second_id"),
        F.round("distance", 1).alias("distance_m"), F.col("reason"),
        F.col("a.site_rows").alias("first_rows"), F.col("b.site_rows").alias("second_rows"),
    ]
    return by_name.select(*columns).unionByName(by_contact.select(*columns))


def near_duplicates(df: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """Rows with the same name or contact within the radius.

    Input: id, name_key, contact_key ('' = none), lat, lng. Rows that share name, contact and point
    form one site; the result links every further row of a site to the site's first row (distance 0)
    and every pair of close sites through their first rows, with the number of rows on each side. A
    hot site costs as many rows as it has members, never all pairs.
    """
    sites = cut_lineage(_sites(df))  # read by each side of both joins
    inside = join_back(
        df.select("id", "name_key", "contact_key", "lat", "lng"), sites.filter("site_rows > 1"),
        ["name_key", "contact_key", "lat", "lng"],
    ).filter(F.col("id") != F.col("site_id"))
    star = inside.select(
        F.col("site_id").alias("first_id"), F.col("id").alias("second_id"), F.lit(0.0).alias("distance_m"),
        F.when(F.col("contact_key") != "", F.lit("same-name-and-contact")).otherwise(F.lit("same-name")).alias("reason"),
        F.lit(1).cast("bigint").alias("first_rows"), F.lit(1).cast("bigint").alias("second_rows"),
    )
    return _site_pairs(sites, radius_m).unionByName(star)


#: Levels of cells below the first; each has a quarter of the side, the last one some micrometres for 200 m.
_FINEST = 12
#: Pairs of points of two cells up to which their distances are measured one by one.
_MEASURED = 256
_CELL = ("cx", "cy", "cz")


def _cells(points: DataFrame, level: int) -> DataFrame:
    """Cells of a level: rows and points in them, their first row, and the box around the points."""
    cell = [F.shiftright(f, 2 * (_FINEST - level)).alias(f) for f in _CELL]
    box = [f(x).alias(f"{n}_{x}") for x in ("x", "y", "z") for n, f in (("low", F.min), ("high", F.max))]
    return points.groupBy("key", *cell).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("points"), F.min("id").alias("first"), *box)


def _bounds(near: float, far: float) -> Column:
    """Whether all pairs of two boxes a and b are close; NULL: some may be; rows where none is are to be left out by the caller."""
    gaps, spans = [], []
    for x in ("x", "y", "z"):
        a_low, a_high, b_low, b_high = (F.col(f"{s}.{n}_{x}") for s in "ab" for n in ("low", "high"))
        gaps.append(F.pow(F.greatest(F.lit(0.0), a_low - b_high, b_low - a_high), 2))
        spans.append(F.pow(F.greatest(a_high - b_low, b_high - a_low), 2))
    least, most = F.sqrt(gaps[0] + gaps[1] + gaps[2]), F.sqrt(spans[0] + spans[1] + spans[2])
    return F.when(most <= near, F.lit(True)).when(least > far, F.lit(False))


def close_cells(points: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Numbers of close pairs by cell: (key, first, rows, pairs) inside cells and (key, first, second, pairs) between two.

    ``points``: id, key, lat, lng, n (rows at the point), one row per key and point. A cell's diagonal is shorter than the
    radius, so its rows are close by construction. Of two cells, the boxes around their points often say that all pairs are
    close or none; only where they do not, both are cut into quarters by side and asked again, or measured if they
    hold few points. ``first`` and ``second`` are the smallest ids of the cells. Nothing is listed per pair of rows.
    """
    side = radius_m * 0.999 / 3**0.5
    near, far = radius_m - 0.001 - radius_m**3 / (24 * geo.EARTH_M**2), radius_m + 0.001  # chords are shorter than arcs
    axes = dict(zip(("x", "y", "z"), _axes(F.col("lat"), F.col("lng"))))
    places = {c: F.floor(F.col(x) / (side / 4**_FINEST)).cast("bigint") for c, x in zip(_CELL, axes)}
    points = cut_lineage(points.select("id", "key", "lat", "lng", "n").withColumns(axes).withColumns(places))
    cells = cut_lineage(_cells(points, 0))
    inside = cells.select("key", "first", F.col("n").alias("rows"), (F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)").alias("pairs"))
    # close points are at most two cells apart; cells meet in blocks of four by side
    around = cells
    for c in _CELL:
        around = around.withColumn(f"b{c}", F.explode(F.sequence(F.shiftright(F.col(c) - 2, 2), F.shiftright(F.col(c) + 2, 2))))
    home = cells.withColumns({f"b{c}": F.shiftright(c, 2) for c in _CELL})
    a, b = around.alias("a"), home.alias("b")
    meet = F.col("a.key") == F.col("b.key")
    for c in _CELL:
        meet = meet & (F.col(f"a.b{c}") == F.col(f"b.b{c}")) & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 2)
    place = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in _CELL])
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in (*_CELL, "n", "points")]
    met = a.join(b, meet & (place("a") < place("b"))).select(
        F.col("a.key").alias("key"), F.col("a.first").alias("first"), F.col("b.first").alias("second"), *sides, _bounds(near, far).alias("close"))
    between: DataFrame | None = None

    def add(rows: DataFrame) -> None:
        nonlocal between
        own = rows.select("key", "first", "second", (F.col("a_n") * F.col("b_n")).cast("decimal(38,0)").alias("pairs"))
        between = own if between is None else between.unionByName(own)

    for level in range(_FINEST + 1):
        state = cut_lineage(met.filter(F.col("close").isNull() | F.col("close")))
        add(state.filter("close"))
        unsure = state.filter("close is null")
        few = (F.col("a_points") * F.col("b_points") <= _MEASURED) | F.lit(level == _FINEST)
        here = points.select("key", "lat", "lng", "n", *[F.shiftright(c, 2 * (_FINEST - level)).alias(c) for c in _CELL])
        ends = unsure.filter(few).drop("a_n", "b_n")
        for s in "ab":
            ends = ends.join(here.toDF("key", f"{s}_lat", f"{s}_lng", f"{s}_n", *[f"{s}_{c}" for c in _CELL]), ["key", *[f"{s}_{c}" for c in _CELL]])
        add(ends.filter(geo.haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) <= radius_m))
        many = unsure.filter(~few)
        if level == _FINEST or many.isEmpty():
            break
        finer = _cells(points, level + 1)
        parents = [F.shiftright(F.col(c), 2) for c in _CELL]
        met = many.select("key", "first", "second", *[f"{s}_{c}" for s in "ab" for c in _CELL]).alias("m")
        for s in "ab":
            own = finer.select("*", *[p.alias(f"p{c}") for p, c in zip(parents, _CELL)]).alias(s)
            on = F.col("m.key") == F.col(f"{s}.key")
            for c in _CELL:
                on = on & (F.col(f"m.{s}_{c}") == F.col(f"{s}.p{c}"))
            met = met.join(own, on)
        met = met.select(F.col("m.key").alias("key"), F.col("m.first").alias("first"), F.col("m.second").alias("second"), *sides, _bounds(near, far).alias("close"))
    return inside, between.groupBy("key", "first", "second").agg(F.sum("pairs").alias("pairs"))


def _keyed_points(df: DataFrame) -> DataFrame:
    """Points by name, by contact and by both: id, key, lat, lng, n."""
    sites = _sites(df)
    kinds = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("name_key").alias("name"), F.lit("").alias("contact")),
        F.when(F.col("contact_key") != "", F.struct(F.lit("contact").alias("kind"), F.lit("").alias("name"), F.col("contact_key").alias("contact"))),
        F.when(F.col("contact_key") != "", F.struct(F.lit("both").alias("kind"), F.col("name_key").alias("name"), F.col("contact_key").alias("contact"))),
    )
    rows = sites.select(F.explode(F.array_compact(kinds)).alias("key"), "lat", "lng", "site_id", "site_rows")
    return rows.filter("key.kind <> 'name' or key.name is not null").groupBy("key", "lat", "lng").agg(F.min("site_id").alias("id"), F.sum("site_rows").alias("n"))


def near_duplicate_cells(df: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """Near duplicates by cell, in place of pairs: (kind, name, contact, first_id, second_id, pairs).

    One row per cell with several rows of a key (``second_id`` NULL) and one per two cells with close rows; ``pairs`` counts
    the pairs of rows. The size is linear in the cells however many rows a cell holds. Kinds: name and contact.
    """
    inside, between = close_cells(_keyed_points(df).filter("key.kind <> 'both'"), radius_m)
    none = F.lit(None).cast(df.schema["id"].dataType)
    rows = inside.filter("rows > 1").select("key.*", F.col("first").alias("first_id"), none.alias("second_id"), "pairs")
    return rows.unionByName(between.select("key.*", F.col("first").alias("first_id"), F.col("second").alias("second_id"), "pairs"))


def near_duplicate_count(df: DataFrame, radius_m: float = 200.0) -> DataFrame:
    """Exact number of near-duplicate row pairs, counted by cells without listing them.

    Pairs of one name, and of one contact less those that share the name, too.
    """
    inside, between = close_cells(_keyed_points(df), radius_m)
    both = inside.select("key", "pairs").unionByName(between.select("key", "pairs"))
    signed = F.when(F.col("key.kind") == "both", -F.col("pairs")).otherwise(F.col("pairs"))
    # rows at one point without a name are one site, as in near_duplicates
    nameless = _sites(df).filter("name_key is null").select((F.col("site_rows") * (F.col("site_rows") - 1) / 2).cast("decimal(38,0)").alias("n"))
    return both.select(signed.alias("n")).unionByName(nameless).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pairs"))


def exact_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a key that occurs more than once, with the number of copies."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return join_back(df, repeated, list(keys))


def repeated_names(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("branches")).filter("branches > 1")


def nearest_centre(lat: Column, lng: Column, centres: Sequence[tuple[str, float, float]] = P.REGION_CENTRES) -> Column:
    """Name of the closest centre of a short fixed list (a struct minimum, no join)."""
    if len(centres) > MAX_LITERAL_CENTRES:
        raise ValueError("too many centres for a literal list")
    return F.least(
        *[
            F.struct(geo.haversine_m(lat, lng, F.lit(y), F.lit(x)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"))
            for i, (n, y, x) in enumerate(centres)
        ]
    )["name"]


def match_one_to_one(left: DataFrame, right: DataFrame, first_cell: float = 2e-5,
                     growth: float = 64.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Greedy one-to-one nearest match by name, in left order, without walking the rows one by one.

    ``left``: id, ord, name_key, lat, lng; ``right``: the same columns. Taking left rows in ``ord``
    and giving each the nearest unused record is a stable matching in which every record prefers the
    lower ``ord``; that matching is unique, so it can be found in rounds of proposals: a free row
    proposes to its nearest record that would still take it, and a record keeps its lowest bidders.
    The nearest record is searched in grid cells that grow only for rows still without an offer.
    Records at one point count as one site with a capacity; between sites at exactly equal distance
    the one holding the earliest record wins.

    Returns (matches: left_id, right_id, distance), unmatched left ids, unmatched right ids.
    """
    levels, size = [], first_cell
    while size < 720.0:
        levels.append(size)
        size *= growth
    levels.append(1e6)

    sites = cut_lineage(
        right.groupBy("name_key", "lat", "lng").agg(
            F.count(F.lit(1)).alias("capacity"), F.min("ord").alias("site_ord"), F.min("id").alias("site")
        )
    )
    cells = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("lat") / s).alias("cy"),
                               F.floor(F.col("lng") / s).alias("cx")) for i, s in enumerate(levels)])
    site_cells = sites.select(
        F.col("name_key").alias("k"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), "site", "site_ord",
        F.explode(cells).alias("c"),
    ).select("k", "s_lat", "s_lng", "site", "site_ord", "c.*")
    sizes = F.create_map(*[x for i, s in enumerate(levels) for x in (F.lit(i), F.lit(s))])

    names = sites.select("name_key").distinct()
    rows = left.select("id", "ord", "name_key", "lat", "lng")
    free = cut_lineage(rows.join(names, "name_key", "left_semi").withColumn("level", F.lit(0)))
    held = None
    while not free.isEmpty():  # each round settles a row, drops a bid for good or widens a search, so the rounds end
        size_now = F.element_at(sizes, F.col("level"))
        looking = free.withColumn("cy", F.explode(geo.neighbours(F.floor(F.col("lat") / size_now)))).withColumn(
            "cx", F.explode(geo.neighbours(F.floor(F.col("lng") / size_now)))
        )
        near = _near_sites(looking, site_cells)
        near = near.withColumn("distance", geo.planar(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")))
        near = near.filter(F.col("distance") <= F.element_at(sizes, F.col("level")))
        if held is not None:
            full = held.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("worst"))
            closed = full.join(sites.select("site", "capacity"), "site").filter("n >= capacity").select("site", "worst")
            near = near.join(closed, "site", "left").filter(F.col("worst").isNull() | (F.col("ord") < F.col("worst")))
        offers = near.groupBy("id").agg(F.min(F.struct("distance", "site_ord", "site")).alias("best"))
        tried = cut_lineage(free.join(offers, "id", "left"))
        bids = tried.filter(F.col("best").isNotNull()).select(
            "id", "ord", "name_key", "lat", "lng", "level", F.col("best.site").alias("site"),
            F.col("best.distance").alias("distance"),
        )
        pool = bids if held is None else held.unionByName(bids)
        ranked = occurrence_number(pool, ["site"], [F.col("ord")], F.floor(F.col("ord") / 4096), "rank")
        ranked = cut_lineage(ranked.join(sites.select("site", "capacity"), "site"))
        held = ranked.filter("rank <= capacity").select(*pool.columns)
        beaten = ranked.filter("rank > capacity").select("id", "ord", "name_key", "lat", "lng", "level")
        wider = tried.filter(F.col("best").isNull() & (F.col("level") < len(levels) - 1)).select(
            "id", "ord", "name_key", "lat", "lng", (F.col("level") + 1).alias("level")
        )
        free = cut_lineage(beaten.unionByName(wider))

    if held is None:
        held = free.withColumn("site", F.col("id")).withColumn("distance", F.lit(0.0))
    taken = occurrence_number(
        held.select("id", "ord", "site", "distance"), ["site"], [F.col("ord")], F.floor(F.col("ord") / 4096), "rank"
    )
    copies = join_back(
        right.select("id", "ord", "name_key", "lat", "lng"), sites.select("name_key", "lat", "lng", "site"),
        ["name_key", "lat", "lng"],
    ).select(F.col("id").alias("right_id"), "ord", "site")
    copies = occurrence_number(copies, ["site"], [F.col("ord")], F.floor(F.col("ord") / 4096), "rank").drop("ord")
    matches = taken.join(copies, ["site", "rank"]).select(F.col("id").alias("left_id"), "right_id", "distance")
    lost_left = left.select("id").join(matches.select(F.col("left_id").alias("id")), "id", "left_anti")
    lost_right = right.select("id").join(matches.select(F.col("right_id").alias("id")), "id", "left_anti")
    return matches, lost_left, lost_right


def _near_sites(looking: DataFrame, site_cells: DataFrame) -> DataFrame:
    cells = site_cells.select(
        F.col("k").alias("name_key"), "level", "cy", "cx", "s_lat", "s_lng", "site", "site_ord"
    )
    return looking.join(cells, ["name_key", "level", "cy", "cx"])


def match_parity_breaks(pairs: DataFrame, as_of: Column, tolerance: float = 1e-5) -> Column:
    """Codes where a matched row differs from its record (columns ``x`` and ``r_x``)."""
    expected = F.when(F.col("r_effective_to") < as_of, F.lit("expired")).otherwise(F.lit("active"))
    checks = {
        "NAME": text.norm_key(F.col("name")) != text.norm_key(F.col("r_name")),
        "ADDRESS": ~text.collapse_ws(F.col("address")).eqNullSafe(text.collapse_ws(F.col("r_address"))),
        "LAT": F.abs(F.col("lat") - F.col("r_lat")) > tolerance,
        "LNG": F.abs(F.col("lng") - F.col("r_lng")) > tolerance,
        "EXPIRY": ~F.col("effective_to").eqNullSafe(F.col("r_effective_to")),
        "CHECKED": ~F.col("checked_at").eqNullSafe(as_of),
        "STATUS": ~F.col("status").eqNullSafe(expected),
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in checks.items()])
    )


def refresh_from_records(entities: DataFrame, records: DataFrame, key: str, as_of: Column,
                         review_days: int = 30) -> DataFrame:
    """Rewrite matched entities from their records: name, address, point (5 decimals), dates, status."""
    r = records.select(
        F.col(key).alias("__k"), F.col("name").alias("__name"), F.col("address").alias("__address"),
        F.round("lat", 5).alias("__lat"), F.round("lng", 5).alias("__lng"), F.col("effective_to").alias("__to"),
    )
    j = entities.join(r, F.col(key) == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    status = F.when(F.col("__to") < as_of, F.lit("expired")).otherwise(F.lit("active"))
    new = {
        "name": F.col("__name"), "address": F.col("__address"), "lat": F.col("__lat"), "lng": F.col("__lng"),
        "effective_to": F.col("__to"), "checked_at": as_of, "status": status,
        "next_review_at": F.when(status == "expired", as_of).otherwise(F.date_add(as_of, review_days)),
    }
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in entities.columns])


def normalize_directory(legacy: DataFrame, country: str, as_of: Column, checked_at: Column,
                        next_review: Column, default_url: str) -> DataFrame:
    """Legacy rows to canonical rows: ids, regions, precision, enums, evidence, status, eligibility.

    Input: name, place, type, source, expiry, contact, state, postcode, lat, lng.
    """
    kind = text.contact_kind(F.col("contact"))
    to = dates.english_date(F.col("expiry"))
    if country == "NZ":
        register = F.col("source") == "register"
        source_kind = F.when(register, F.lit("government-register")).otherwise(F.lit("industry-association"))
        source_url = F.lit(default_url)
        region = nearest_centre(F.col("lat"), F.col("lng"))
        branch = F.col("place")
        address = F.when(register | F.col("place").rlike(r"\d"), F.col("place"))
        precision = text.precision_of(F.lit("NZ"), F.col("place"), register)
        status = F.when(to < as_of, F.lit("expired")).otherwise(F.lit("active"))
        scheme, classification = F.lit("nz-whv-extension"), F.lit("conditional")
        location_check = F.lit(False)
    else:
        is_url = F.col("source").rlike(r"\Ahttps?:")
        gateway_url = is_url & F.contains("source", F.lit("dewr.gov.au"))
        source_kind = (
            F.when(gateway_url | (F.col("source") == "job-gateway"), F.lit("government-job-gateway"))
            .when(is_url, F.lit("industry-association"))
            .when(F.col("source") == "employer-official", F.lit("employer-official"))
            .otherwise(F.lit("unverified"))
        )
        source_url = F.when(is_url, F.col("source")).otherwise(F.coalesce("contact", F.lit(default_url)))
        region = F.col("state")
        branch = F.concat_ws("-", "state", "postcode", "place")
        address = F.lit(None).cast("string")
        precision = text.precision_of(F.lit("AU"), F.col("place"))
        status = F.when((source_kind == "unverified") | (kind == "none"), F.lit("uncertain")).otherwise(F.lit("active"))
        gateway = text.work_type(F.col("type")) == "job-gateway"
        scheme = F.when(gateway, F.lit("none")).otherwise(F.lit("au-417-specified-work"))
        classification = F.when(gateway, F.lit("not-applicable")).otherwise(F.lit("conditional"))
        location_check = F.lit(True)
    return legacy.select(
        fingerprints.stable_id(F.lit(country), F.col("source"), F.col("name"), branch).alias("id"),
        F.lit(country).alias("country"), "name",
        F.struct(
            F.col("place").alias("label"), address.alias("address"), region.alias("region"),
            (F.lit(None).cast("string") if country == "NZ" else F.col("state")).alias("state"),
            (F.lit(None).cast("string") if country == "NZ" else F.col("postcode")).alias("postcode"),
            F.col("lat"), F.col("lng"), precision.alias("precision"),
        ).alias("location"),
        F.array(text.work_type(F.col("type"))).alias("workTypes"),
        F.struct(source_kind.alias("kind"), source_url.alias("url"), checked_at.alias("checkedAt"),
                 (to if country == "NZ" else F.lit(None).cast("date")).alias("effectiveTo")).alias("source"),
        F.struct(kind.alias("kind"), F.when(F.col("contact") != "", F.col("contact")).alias("url")).alias("contact"),
        status.alias("status"), next_review.alias("nextReviewAt"), F.lit("directory-only").alias("vacancyStatus"),
        F.struct(scheme.alias("scheme"), classification.alias("classification"), F.lit(True).alias("requiresRoleCheck"),
                 location_check.alias("requiresLocationCheck")).alias("eligibility"),
    )


def refresh_work_types(df: DataFrame, column: str = "work_types") -> DataFrame:
    return df.withColumn(column, F.transform(column, text.work_type))


def downgrade_coordinates(df: DataFrame) -> DataFrame:
    """Exact points of NZ rows become town points (they were geocoded, not reviewed)."""
    legacy = (F.col("country") == "NZ") & (F.col("precision") == "exact")
    return df.withColumn("precision", F.when(legacy, F.lit("town")).otherwise(F.col("precision")))


def default_regions(df: DataFrame) -> DataFrame:
    empty = (F.col("country") == "AU") & (F.coalesce(F.col("region"), F.lit("")) == "")
    return df.withColumn("region", F.when(empty, F.col("state")).otherwise(F.col("region")))


def evidence_bindings(entities: DataFrame) -> DataFrame:
    """One evidence row per entity (id, country, source_class, source_kind, source_url, contact_kind, precision)."""
    cls = F.col("source_class")
    own = fingerprints.source_id(F.col("source_kind"), F.col("source_url"))
    return entities.select(
        F.concat(F.lit("evidence-"), "id").alias("binding_id"), F.col("id").alias("entity_id"),
        F.when(cls.isin("register", "industry-list", "membership"), F.concat_ws("-", F.lit("cohort"), cls))
        .otherwise(own).alias("source_id"),
        classify.evidence_level(cls).alias("level"),
        classify.evidence_scopes(cls, F.col("contact_kind")).alias("scopes"),
        classify.location_scope(cls, F.col("precision")).alias("location_scope"),
        classify.limitations(F.col("country"), cls).alias("limitations"),
    )


def evidence_audit(bindings: DataFrame) -> DataFrame:
    """One row of conditional counts over the bindings."""
    level = F.col("level")

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    return bindings.agg(
        F.countDistinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("bindings"),
        F.countDistinct("source_id").alias("sources"),
        count(level == "machine-extracted").alias("machine_extracted"), count(level == "hybrid").alias("hybrid"),
        count(level == "reviewed-snapshot").alias("reviewed_snapshot"),
        count(level == "limited-candidate").alias("limited_candidate"),
        count(level.isin("machine-extracted", "hybrid")).alias("exact_entity"),
        count(level == "machine-extracted").alias("exact_location"),
        count(level.isin("hybrid", "reviewed-snapshot")).alias("reviewed_location"),
        count(level == "limited-candidate").alias("limited_location"),
        count(F.array_contains("scopes", "contact")).alias("contact_scope"),
        count(F.size("limitations") > 0).alias("with_limitations"),
        F.countDistinct(F.when(level.isin("machine-extracted", "hybrid"), F.col("source_id"))).alias("machine_sources"),
    )


def directory_audit(entities: DataFrame) -> DataFrame:
    """(metric, value, n): totals, by country, by status, contactable, expired."""
    sets = entities.groupingSets([[], ["country"], ["status"]], "country", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("contact_kind") != "none").alias("contactable"),
        F.grouping_id("country", "status").alias("gid"),
    )
    rows = F.when(F.col("gid") == 3, F.array(
        F.struct(F.lit("rows").alias("metric"), F.lit("").alias("value"), F.col("n").alias("n")),
        F.struct(F.lit("contactable").alias("metric"), F.lit("").alias("value"), F.col("contactable").alias("n")),
    )).when(F.col("gid") == 1, F.array(
        F.struct(F.lit("country").alias("metric"), F.col("country").alias("value"), F.col("n").alias("n"))
    )).otherwise(F.array(
        F.struct(F.lit("status").alias("metric"), F.col("status").alias("value"), F.col("n").alias("n"))
    ))
    return sets.select(F.explode(rows).alias("r")).select("r.*")


def locator_count(entities: DataFrame) -> DataFrame:
    """Number of distinct source and contact addresses."""
    urls = entities.select(F.explode(F.array_compact(F.array("source_url", "contact_url"))).alias("url"))
    return urls.agg(F.countDistinct("url").alias("locators"))
