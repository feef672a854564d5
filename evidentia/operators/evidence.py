"""Record-level operators: gates, metrics, distances, merging, ranking, averages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import geo, lease, num, text
from evidentia.operators.staging import staged

TOTALS = r"(?i)\b(total|average|avg|summary|subtotal)\b"
NOT_GEOCODED = 9999.0


def backfill_dates(records: DataFrame, periods: DataFrame, field: str, mark: str = "~") -> DataFrame:
    """Blank dates take their source's report period, marked as circa; a reported date stays."""
    joined = records.join(periods, "source", "left")
    blank = F.trim(F.coalesce(F.col(field), F.lit(""))) == ""
    return joined.withColumn(field, F.when(blank & F.col("period").isNotNull(), F.concat(F.lit(mark), "period")).otherwise(F.col(field))).drop("period")


def row_gate(records: DataFrame, subject: str, share: float = 0.75, least: int = 1) -> DataFrame:
    """Rows with a name and a price that are neither totals nor the subject itself."""
    words = F.array(*[F.lit(w) for w in sorted({w for w in subject.lower().split() if not w.isdigit()})])
    needed = F.greatest(F.lit(least), F.ceil(F.size(words) * share))
    same = F.size(F.array_intersect(text.tokens(F.col("property_name")), words)) >= needed
    named = F.coalesce(F.trim("property_name"), F.lit("")) != ""
    return records.where(named & (F.coalesce("price_m", F.lit(0.0)) != 0) & ~F.col("property_name").rlike(TOTALS) & ~same)


def real_candidate(records: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with a name and at least one other field."""
    filled = sum((F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return records.where((F.coalesce("property_name", F.lit("")) != "") & (filled >= 1))


def sale_metrics(records: DataFrame, subject_years: float, foreign: bool = False) -> DataFrame:
    """price_psf (derived), ftm_yield and adj_yield (reported, else the yield brought to the subject's lease)."""
    staked = records.withColumn("stake", num.stake_fraction(F.col("sale_type"), F.lit("")))
    rated = lease.with_factor(staked, "remaining_yrs", "own_factor").withColumn("subject_factor", lease.literal_factor(F.lit(float(subject_years))))
    psf = F.round(F.try_divide(F.try_divide(F.col("price_m"), F.col("stake")) * 1_000_000, F.col("gfa_sf").cast("double")), 0)
    derived = F.col("npi_yield") if foreign else F.col("npi_yield") * F.col("own_factor") / F.col("subject_factor")
    return rated.select("*", psf.alias("price_psf"), F.coalesce("reported_adj", derived).alias("adj_yield"))


def with_distance(records: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """distance_km to a point; the sentinel where a record has no place."""
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(lon0), F.lit(lat0))
    return records.withColumn("distance_km", F.coalesce(km, F.lit(NOT_GEOCODED)))


def with_markers(records: DataFrame, by: list[str]) -> DataFrame:
    """Marker 1..n in order of relevance, within ``by``."""
    return records.withColumn("marker", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance_score"), "pos")))


def rank_and_trim(records: DataFrame, limit: int) -> DataFrame:
    """The most relevant records; a top-k, so no global sort."""
    return records.orderBy(F.desc("relevance_score"), "pos").limit(limit)


def positive_averages(records: DataFrame, fields: list[str], by: list[str] = ()) -> DataFrame:
    """Averages over values above zero, as an average row shows them."""
    return records.groupBy(*by).agg(*[F.avg(F.when(F.col(f) > 0, F.col(f))).alias(f"avg_{f}") for f in fields])


def near_pairs(records: DataFrame, km: float) -> DataFrame:
    """a.* , b.* pairs with a.pos < b.pos within km: an equi-join on cells of the globe (``geo.cell``), one side on all 27 neighbours."""
    placed = records.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_c", geo.cell(F.col("lon"), F.col("lat"), km))
    a = placed.alias("a")
    b = placed.withColumn("_n", F.explode(geo.around(F.col("_c")))).alias("b")
    near = geo.haversine_km(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) <= km
    return a.join(b, (F.col("a._c") == F.col("b._n")) & (F.col("a.pos") < F.col("b.pos")) & near)


def deal_classes(records: DataFrame, km: float, overlap: float) -> tuple[DataFrame, DataFrame]:
    """Records (pos, source, price) with their class ``g``, and links (g, other) between classes, both ways, of which no class has one to itself.

    A class is a place and a set of name tokens; two are linked within km and with sets that overlap by at least so much.
    Short sets overlap so much when they are equal only, and meet on the whole set; of longer ones all but
    ``ceil(overlap * n) - 1`` tokens, in an order by hash, are met on. A crowd under one name at one place is one row here."""
    priced = records.where("lon IS NOT NULL AND lat IS NOT NULL AND price_m > 0 AND source IS NOT NULL")
    named = priced.withColumn("_t", F.array_sort(F.array_distinct(F.transform(text.tokens(F.col("property_name")), lambda t: F.xxhash64(t))))).where(F.size("_t") > 0)
    placed = named.select("pos", "source", F.col("price_m").cast("double").alias("price"), F.struct("lon", "lat", F.xxhash64("_t").alias("name")).alias("g"), "_t")
    exact = F.size("_t") / (overlap - 1e-9) < F.size("_t") + 1
    kept = F.size("_t") - F.ceil(F.size("_t") * (overlap - 1e-9)).cast("int") + 1
    met_on = F.when(exact, F.array(F.col("g.name"))).otherwise(F.slice("_t", F.lit(1), kept))
    classes = placed.groupBy("g").agg(F.first("_t").alias("_t")).select("g", "_t", geo.cell(F.col("g.lon"), F.col("g.lat"), km).alias("_c"), F.explode(met_on).alias("_k"))
    x, y = classes.alias("x"), classes.withColumn("_n", F.explode(geo.around(F.col("_c")))).alias("y")
    common = F.array_intersect("x._t", "y._t")
    share = F.size(common) / F.size(F.array_union("x._t", "y._t")) >= overlap
    near = geo.haversine_km(F.col("x.g.lon"), F.col("x.g.lat"), F.col("y.g.lon"), F.col("y.g.lat")) <= km
    met = (F.col("x._c") == F.col("y._n")) & (F.col("x._k") == F.col("y._k")) & (F.col("x.g") != F.col("y.g"))
    links = x.join(y, met).where(share & near).select(F.col("x.g").alias("g"), F.col("y.g").alias("other")).distinct()
    return placed.drop("_t"), links


def named_alike(records: DataFrame, km: float, overlap: float) -> DataFrame:
    """a, b (structs of the records' columns, a.pos < b.pos): all pairs of different sources with prices in one class or in linked ones, which a crowd has very many of."""
    placed, links = deal_classes(records, km, overlap)
    near = links.unionByName(placed.select("g", F.col("g").alias("other")).distinct())
    x, y = placed.join(near, "g").alias("x"), placed.alias("y")
    pairs = x.join(y, (F.col("x.other") == F.col("y.g")) & (F.col("x.source") != F.col("y.source")) & (F.col("x.pos") < F.col("y.pos"))).select(F.col("x.pos").alias("i"), F.col("y.pos").alias("j"))
    whole = lambda name, key: records.select(F.struct(*records.columns).alias(name), F.col("pos").alias(key))
    return pairs.join(whole("a", "i"), "i").join(whole("b", "j"), "j").select("a", "b")


def conflict_flags(records: DataFrame, km: float = 0.1, tolerance: float = 0.03, overlap: float = 0.9) -> DataFrame:
    """A note on both records of a pair from different sources, at one place and under one name, whose prices differ; the last pair's note stays.

    A record's last pair is the one with the greatest pos. Prices too low for a record are a beginning of its class in order of
    price, those too high an end in order of the price that they allow at most; so the greatest pos and the greatest of
    another source run along both orders, and no pair is formed."""
    placed, links = deal_classes(records, km, overlap)
    x = F.col("price")
    low = x - x * tolerance  # a lower price differs by too much; this one itself, if what is rounded says so
    at = (x - low) > x * tolerance
    row = lambda side, k, tie, asks: F.struct(F.lit(side).alias("side"), k.alias("k"), tie.alias("tie"), F.lit(asks).alias("asks"))
    given = [row(0, x, F.lit(1), False), row(1, -low, F.when(at, 0).otherwise(2), False)]
    asked = [row(0, low, F.when(at, 2).otherwise(0), True), row(1, -x, F.lit(1), True)]
    own = placed.select("g", "pos", "source", F.explode(F.array(*given, *asked)).alias("e"))
    beside = placed.join(links, "g").select(F.col("other").alias("g"), "pos", "source", F.explode(F.array(*asked)).alias("e"))
    before = Window.partitionBy("g", "e.side").orderBy("e.k", "e.tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.unionByName(beside).withColumn("r", F.struct("pos", "source"))
    led = rows.withColumn("m", F.max(F.when(~F.col("e.asks"), F.col("r"))).over(before))
    # the greatest so far and, beside it, the greatest of another source: whoever is passed or comes second is one
    second = F.when(~F.col("e.asks") & (F.col("source") != F.col("m.source")), F.least("r", "m"))
    both = led.withColumn("s", F.max(second).over(before)).where("e.asks")
    best = both.select("pos", F.when(F.col("m.source") != F.col("source"), F.col("m")).otherwise(F.col("s")).alias("b"))
    return best.where("b IS NOT NULL").groupBy("pos").agg(F.max("b").alias("b")).select("pos", F.col("b.pos").alias("conflicts_with"), F.col("b.source").alias("conflict_source"))


def priced_alike(records: DataFrame, km: float, overlap: float, tolerance: float) -> DataFrame:
    """a, b (pos, a < b): pairs of different sources in one class or in linked ones (``deal_classes``), with prices within the tolerance.

    Prices meet on steps of their logarithm, as wide as the tolerance, so that a crowd under one name is met by price."""
    placed, links = deal_classes(records, km, overlap)
    step = placed.withColumn("step", F.floor(F.log("price") / (-math.log1p(-tolerance) * 1.0001)))
    own = step.withColumn("n", F.explode(F.array(F.col("step"), F.col("step") + 1))).withColumn("own", F.lit(True))
    beside = step.join(links.where("g < other"), "g").withColumn("g", F.col("other")).drop("other").withColumn("n", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).withColumn("own", F.lit(False))
    a, b = step.alias("x"), own.unionByName(beside).alias("y")
    p, q = F.col("x.price"), F.col("y.price")
    met = (F.col("x.g") == F.col("y.g")) & (F.col("x.step") == F.col("y.n")) & (F.col("x.source") != F.col("y.source")) & (F.abs(p - q) <= tolerance * F.greatest(p, q))
    once = ~F.col("y.own") | (F.col("x.step") != F.col("y.step")) | (F.col("x.pos") < F.col("y.pos"))
    return a.join(b, met & once).select(F.least("x.pos", "y.pos").alias("a"), F.greatest("x.pos", "y.pos").alias("b"))


def places_within(places: DataFrame, km: float) -> DataFrame:
    """lon, lat, to_lon, to_lat: places (lon, lat) within km of each other, each also of itself; an equi-join on cells of different places only."""
    x = places.select("lon", "lat").distinct().withColumn("_c", geo.cell(F.col("lon"), F.col("lat"), km)).alias("x")
    y = places.select("lon", "lat").distinct().withColumn("_n", F.explode(geo.around(geo.cell(F.col("lon"), F.col("lat"), km)))).alias("y")
    near = geo.haversine_km(F.col("x.lon"), F.col("x.lat"), F.col("y.lon"), F.col("y.lat")) <= km
    return x.join(y, (F.col("x._c") == F.col("y._n")) & near).select("x.lon", "x.lat", F.col("y.lon").alias("to_lon"), F.col("y.lat").alias("to_lat"))


def same_building(records: DataFrame, probes: DataFrame, km: float = 0.075, tolerance: float = 0.05) -> DataFrame:
    """For every probe the first record (by pos) at its place and price.

    A place's prices lie in steps of their logarithm, a little narrower than the tolerance: all of a probe's own step are
    near it, of the two steps below an end in order of price, of the two above a beginning. The least pos runs along both
    orders, so that no pair is formed where a place has a crowd."""
    ready = lambda df: df.where("lon IS NOT NULL AND lat IS NOT NULL AND price_m > 0").select("pos", "lon", "lat", F.col("price_m").cast("double").alias("x")).withColumn("step", F.floor(F.log("x") / (-math.log1p(-tolerance) * 0.9999)))
    x = F.col("x")
    low = x - x * tolerance  # a lower price differs by too much; this one itself, if what is rounded says so
    at = (x - low) > x * tolerance
    row = lambda side, off, k, tie: F.struct(F.lit(side).alias("side"), (F.col("step") + off).alias("step"), k.alias("k"), tie.alias("tie"))
    given = F.array(row(0, 0, -x, F.lit(1)), row(1, 0, low, F.when(at, 2).otherwise(0)))
    below, above = (-low, F.when(at, 0).otherwise(2)), (x, F.lit(1))
    asked = F.array(row(0, -2, *below), row(0, -1, *below), row(0, 0, F.lit(float("inf")), F.lit(1)), row(1, 1, *above), row(1, 2, *above))
    stored = ready(records).select("lon", "lat", F.explode(given).alias("e"), F.col("pos").alias("r"), F.lit(None).cast("long").alias("p"))
    near = places_within(records.select("lon", "lat").unionByName(probes.select("lon", "lat")).where("lon IS NOT NULL AND lat IS NOT NULL"), km)
    asking = ready(probes).join(near, ["lon", "lat"]).select(F.col("to_lon").alias("lon"), F.col("to_lat").alias("lat"), F.explode(asked).alias("e"), F.lit(None).cast("long").alias("r"), F.col("pos").alias("p"))
    before = Window.partitionBy("lon", "lat", "e.side", "e.step").orderBy("e.k", "e.tie").rowsBetween(Window.unboundedPreceding, -1)
    found = stored.unionByName(asking).withColumn("first", F.min("r").over(before)).where("p IS NOT NULL AND first < p")
    return found.groupBy(F.col("p").alias("pos")).agg(F.min("first").alias("same_as"))


def first_by_key(records: DataFrame, key: Column) -> DataFrame:
    """The first record (by pos) of every key: a grouped minimum, so hot keys combine before the shuffle."""
    keyed = records.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min("pos").alias("_first"))
    return keyed.join(first.select(F.col("_first").alias("pos")), "pos", "left_semi").drop("_key")


def leader_groups(edges: DataFrame) -> DataFrame:
    """pos and leader of every record in a group: records in order of pos, a member joins the first leader that reaches it, and a member never leads.

    ``edges`` (a, b) with a < b. Solved in rounds: a record leads as soon as every
    smaller neighbour is known to be a member, and is a member as soon as one
    smaller neighbour leads, so that each round is a join, not a fold in one task."""
    undecided = staged(edges.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "nodes")
    leaders, members = None, None
    edges = staged(edges.select("a", "b").distinct(), "edges")
    while not undecided.isEmpty():
        waiting = edges.join(undecided.select(F.col("n").alias("a")), "a", "left_semi").select("b").distinct()
        now = undecided.join(waiting, undecided["n"] == waiting["b"], "left_anti")
        all_leaders = now if leaders is None else leaders.unionByName(now)
        taken = edges.join(now.select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        all_members = taken if members is None else members.unionByName(taken)
        leaders, members = staged(all_leaders, "leaders", leaders), staged(all_members.distinct(), "members", members)
        undecided = staged(undecided.join(leaders, "n", "left_anti").join(members, "n", "left_anti"), "nodes", undecided)
    if leaders is None:
        return edges.select(F.col("b").alias("pos"), F.col("a").alias("leader")).limit(0)
    led = edges.join(leaders.select(F.col("n").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("pos")).agg(F.min("a").alias("leader"))
    return led.unionByName(led.select(F.col("leader").alias("pos"), "leader").distinct())


def merge_cross_source(records: DataFrame, fields: list[str], km: float = 0.02, tolerance: float = 0.03, overlap: float = 0.9) -> DataFrame:
    """Deals reported by several sources made one: the most complete record is the base, its blanks are filled in order of pos, sources are joined by ``+``."""
    groups = leader_groups(priced_alike(records.select("pos", "source", "property_name", "price_m", "lon", "lat"), km, overlap, tolerance))
    filled = sum((F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1).otherwise(0) for f in fields), F.lit(0))
    joined = records.join(groups, "pos", "left").withColumn("leader", F.coalesce("leader", "pos")).withColumn("_full", filled)
    # the base first, then by pos; the first that is not null fills a field
    base = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("_full"), "pos"))
    ranked = joined.withColumn("_base", base).withColumn("_order", F.when(base == 1, -1).otherwise(F.col("pos")))
    take = lambda f: F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_order"))).alias(f)
    sources = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda s: s["source"])), "+")
    return ranked.groupBy("leader").agg(F.count("*").alias("n_merged"), sources.alias("source"), *[take(f) for f in fields])


def effective_rent(asking: Column, reported: Column, term_yrs: Column, free_months: Column) -> Column:
    months = term_yrs * 12
    return F.coalesce(reported, F.round(F.try_divide(asking * (months - F.coalesce(free_months, F.lit(0.0))), months), 2))


def land_metrics(sites: DataFrame, subject_years: float) -> DataFrame:
    """Price per plot ratio foot, and the same brought from the site's lease to the subject's."""
    psf = F.round(F.try_divide(F.col("price_m") * 1_000_000, F.col("max_gfa_sf").cast("double")), 0)
    rated = lease.with_factor(sites, "tenure_yrs", "own_factor").withColumn("psf_ppr", psf)
    return rated.withColumn("adj_psf", F.round(F.col("psf_ppr") * lease.literal_factor(F.lit(float(subject_years))) / F.col("own_factor"), 0))


def global_unit_price(price: Column, unit: Column, area: Column, reported: Column) -> Column:
    scale = F.when(unit == "T", 1e3).when(unit == "B", 1e9).otherwise(1e6)
    return F.coalesce(reported, F.try_divide(price * scale, area))


def completeness(fields: list[str]) -> Column:
    return sum((F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1).otherwise(0) for f in fields), F.lit(0))


def auto_flags(area: Column, price: Column, psf: Column, rate: Column) -> Column:
    """Plausibility flags of a record, in a fixed order."""
    ratio = F.try_divide(price * 1_000_000, area * psf)
    return F.array_compact(F.array(
        F.when((area < 500) | (area > 5_000_000), "area out of range"), F.when((price < 0.1) | (price > 10_000), "price out of range"),
        F.when((rate < 0.005) | (rate > 0.2), "yield out of range"), F.when((ratio >= 3) | (ratio <= 1 / 3), "price does not fit area"),
    ))


def scorecard(records: DataFrame, by: list[str]) -> DataFrame:
    """n_valid, coverage, pct_grounded, confidence and ok for a set of acquired records (valid, grounded: boolean; hard: flags)."""
    agg = records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & F.col("grounded")).alias("n_grounded"), F.max("hard").alias("hard"))
    share = agg.withColumn("coverage", F.col("n_valid") / F.col("n")).withColumn("pct_grounded", F.coalesce(F.try_divide("n_grounded", "n_valid"), F.lit(0.0)))
    conf = F.round(F.greatest(F.lit(0.0), 0.5 * F.col("coverage") + 0.5 * F.col("pct_grounded") - 0.2 * F.when(F.col("hard"), 1).otherwise(0)), 3)
    return share.select(*by, "n_valid", "coverage", "pct_grounded", conf.alias("confidence"), (conf >= 0.6).alias("ok"))


#: Words of a description that an asset type accepts, and those that it rejects. Fixed values.
ACCEPT = {
    "office": ("office",),
    "logistics": ("logistic", "warehouse", "cold storage", "distribution centre", "distribution center", "fulfillment", "fulfilment"),
    "industrial": ("industrial", "business park", "factory"),
    "retail": ("retail", "shophouse", "mall"),
    "residential": ("residential", "apartment", "condominium", "condo", "landed"),
}
REJECT = {
    "office": ("residential", "apartment", "condominium", "condo", "hotel", "serviced apartment", "hospitality", "columbarium"),
    "logistics": ("residential", "apartment", "condominium", "condo", "hotel", "serviced apartment", "office"),
    "industrial": ("residential", "apartment", "condominium", "condo", "hotel", "serviced apartment"),
    "retail": ("residential", "apartment", "condominium", "condo", "hotel", "serviced apartment", "logistics park", "warehouse", "industrial estate"),
    "residential": ("office", "logistics park", "logistics centre", "warehouse", "industrial estate"),
}


def asset_type_matches(asset: str, *descriptions: Column) -> Column:
    """An accepted word in any of the descriptions (zoning, sale type, asset type, comment) beats a rejected one; without either, a blank description or an unknown asset type, the record is kept."""
    said = F.lower(F.concat_ws(" ", *[d.cast("string") for d in descriptions]))
    names = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: said.contains(w)) if words else F.lit(False)
    kind = asset.lower()
    return names(ACCEPT.get(kind, ())) | ~names(REJECT.get(kind, ()))


#: Zone keywords in order, each set to be found whole; the first match wins. Fixed values.
ZONE_RULES = (
    (("b1", "business 1"), "B1"), (("b2", "business 2"), "B2"), (("light industrial",), "B1"), (("clean industrial",), "B1"), (("general industrial",), "B2"),
    (("heavy industrial",), "B2"), (("business park", "white"), "BP-W"), (("business park",), "BP"), (("commercial", "residential"), "CR"), (("commercial",), "C"),
    (("residential", "commercial"), "RCO"), (("residential",), "R"), (("hotel",), "H"), (("white",), "W"), (("mixed use",), "MU"), (("civic",), "CI"),
    (("educational", "institution"), "ED"), (("health", "medical"), "HMC"), (("worship",), "PW"), (("sports", "recreation"), "SR"), (("open space",), "OS"),
    (("park",), "PK"), (("transport",), "TP"), (("utility",), "U"), (("agriculture",), "AG"), (("cemetery",), "CE"),
)


def zone_code(zoning: Column, compatible: bool = True) -> Column:
    """Zone code by keyword rules. Compatible: a keyword must stand inside one word, so those of several words never match; otherwise they may."""
    t = F.lower(F.trim(F.coalesce(zoning, F.lit(""))))
    out = F.lit(None).cast("string")
    for words, code in reversed(ZONE_RULES):
        if compatible and any(" " in w for w in words):
            continue
        hit = F.lit(True)
        for w in words:
            hit = hit & t.contains(w)
        out = F.when(hit, code).otherwise(out)
    return out


def rank_within(records: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return records.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
