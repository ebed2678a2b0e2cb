"""Places of stores from free text: towns in addresses and store names, and better coordinates for coarse ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.geo import haversine_km, valid_place

# Words that begin a street's name, and the letters that may be written on them.
STREETS = ("רחוב", "רח", "שדרות", "שדרת", "שדרה", "שד")
GLUED = "[בהלמושכ]?"
#: A hit farther from its town's centre than this is another town's.
FAR_KM = 15.0
#: A longer list of names isn't sent to the tasks.
MOST_NAMES = 200_000


def place_key(text: Column) -> Column:
    """Lower case without quotation marks, one space between words, none around hyphens."""
    x = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "['\"״׳`]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[–—]", "-"), r"\s+", " "), r"\s*-\s*", "-"))


def _tokens(key: Column) -> Column:
    """Words and marks in order; a mark between words keeps a phrase from running over it."""
    return F.regexp_extract_all(key, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))


def _met(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """rows joined with a list of names: sent to the tasks if it has at most MOST_NAMES (counted first), else by a merge join. Never the rows: what was exploded is estimated by what it was made of."""
    return rows.join(F.broadcast(known) if known.limit(MOST_NAMES + 1).count() <= MOST_NAMES else known.hint("merge"), on)


def town_of_text(texts: DataFrame, names: DataFrame, streets: tuple[str, ...] = STREETS, longest: int = 4) -> DataFrame:
    """(text_id, town) of the longest name (alias, town, kind) in each text (text_id, text); ties by alias. kind is town or quarter.

    Runs of up to `longest` words (a hyphen counts as one) meet the names in an equi join; a text's hits are then judged in its row. A town behind a street word, or a street word
    that is a town but leads another word, is the street: it counts only where the text has no other town and no quarter.
    """
    words = texts.repartition("text_id").select("text_id", _tokens(place_key(F.col("text"))).alias("w"))
    starts = words.select("text_id", "w", F.posexplode("w").alias("at", "first"))
    runs = starts.select("text_id", "w", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("at")))).alias("n"))
    street = f"^{GLUED}({'|'.join(streets)})$"
    before, dot = F.get("w", F.col("at") - 1), F.get("w", F.col("at") - 1) == "."
    led = F.coalesce(F.when(dot, F.get("w", F.col("at") - 2)).otherwise(before).rlike(street), F.lit(False))
    after = F.get("w", F.col("at") + F.col("n"))
    own = F.coalesce(F.get("w", F.col("at")).isin(*streets) & (F.col("n") == 1) & after.rlike(r"^\p{L}"), F.lit(False))
    runs = runs.select("text_id", "at", "n", F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("n"))).alias("run"), (led | own).alias("street"))
    known = names.select(F.concat_ws(" ", _tokens(place_key(F.col("alias")))).alias("run"), "alias", "town", "kind")
    hits = _met(runs, known, "run").withColumn("end", F.col("at") + F.col("n"))
    found = hits.groupBy("text_id", "run").agg(
        F.min("town").alias("town"), F.min("kind").alias("kind"), F.min("street").alias("street"), F.min("alias").alias("alias"), F.max("n").alias("n"), F.min(F.struct("at", "end")).alias("span"),
        F.collect_set(F.when(F.col("street"), F.struct("at", "end"))).alias("led"),
    )
    by_text = found.groupBy("text_id").agg(F.flatten(F.collect_list("led")).alias("led"), F.collect_list(F.struct("run", "town", "kind", "street", "alias", "n", "span")).alias("found"))

    def nested(x: Column) -> Column:
        return F.exists("led", lambda s: (s["end"] - s["at"] > x["n"]) & (x["span"]["at"] >= s["at"]) & (x["span"]["end"] <= s["end"]))

    def keyed(x: Column) -> Column:
        tier = F.when((x["kind"] == "town") & ~x["street"], 0).when(x["kind"] == "quarter", 1).otherwise(2)
        return F.struct(tier.alias("tier"), (-F.char_length(x["run"])).alias("length"), x["alias"].alias("alias"), x["town"].alias("town"))

    best = by_text.select("text_id", F.array_min(F.transform(F.filter("found", lambda x: ~nested(x)), keyed)).alias("b"))
    return best.where("b IS NOT NULL").select("text_id", "b.town")


def town_of_store_name(stores: DataFrame, names: DataFrame, noise: tuple[str, ...] = (), short: DataFrame | None = None) -> DataFrame:
    """(store_id, town) from store names (store_id, name): the parts between marks in order, then the whole name.

    Words of `noise` and numbers are left out first; a part without a town may be a short form (short, town).
    """
    clean = F.filter(F.split(F.col("part"), r"\s+"), lambda t: ~place_key(t).rlike(r"^\d*$") & ~place_key(t).isin(*noise, ""))
    parts = stores.repartition("store_id").where(~F.coalesce(F.trim("name").rlike(r"(?i)^store\s*\d+$"), F.lit(True))).select("store_id", F.posexplode(F.array_append(F.filter(F.transform(F.split("name", r"[-–—,@()|/]+"), F.trim), lambda p: p != ""), F.col("name"))).alias("at", "part"))
    tries = parts.select("store_id", "at", F.explode(F.array(F.struct(F.lit(0).alias("raw"), F.concat_ws(" ", clean).alias("text")), F.struct(F.lit(1).alias("raw"), F.col("part").alias("text")))).alias("t")).select("store_id", "at", "t.*").where("text <> ''")
    # A try is a text of its own, so that what is found needs no join back to the stores.
    hits = town_of_text(tries.select(F.struct("store_id", "at", "raw").alias("text_id"), "text"), names).select("text_id.*", F.lit(0).alias("abbreviated"), "town")
    if short is not None:
        said = tries.select("store_id", "at", "raw", F.explode(F.array_union(F.transform(F.split("text", r"\s+"), place_key), F.array(place_key(F.col("text"))))).alias("short"))
        forms = _met(said, short.select(place_key(F.col("short")).alias("short"), "town"), "short")
        hits = hits.unionByName(forms.select("store_id", "at", "raw", F.lit(1).alias("abbreviated"), "town"))
    return hits.groupBy("store_id").agg(F.min(F.struct("at", "raw", "abbreviated", "town")).alias("b")).select("store_id", "b.town")


def unresolved(stores: DataFrame, limit: int = 15) -> DataFrame:
    """(name, stores): the most frequent names of stores without a town, a report of `limit` rows."""
    return stores.where("city IS NULL").groupBy("name").agg(F.count(F.lit(1)).alias("stores")).orderBy(F.desc("stores"), "name").limit(limit)


def upgraded(stores: DataFrame, hits: DataFrame, centres: DataFrame, far_km: float = FAR_KM) -> DataFrame:
    """stores with the coordinates of their address's hit (store_id, hit_lat, hit_lng) where theirs are coarse and the hit is in the country and near the town's centre.

    Coarse is no geo_source or city_centroid; centres (city, c_lat, c_lng).
    """
    rows = stores.join(hits, "store_id", "left").join(centres, "city", "left")
    coarse = F.col("geo_source").isNull() | (F.col("geo_source") == "city_centroid")
    near = haversine_km(F.col("hit_lat"), F.col("hit_lng"), F.col("c_lat"), F.col("c_lng")) <= far_km
    take = F.coalesce(coarse & valid_place(F.col("hit_lat"), F.col("hit_lng")) & near, F.lit(False))
    moved = {"lat": "hit_lat", "lng": "hit_lng"}
    return rows.select(*(F.when(take, F.col(moved[c])).otherwise(F.col(c)).alias(c) if c in moved else F.when(take, "address").otherwise(F.col(c)).alias(c) if c == "geo_source" else F.col(c) for c in stores.columns))


def located(requests: DataFrame, stores: DataFrame) -> DataFrame:
    """`located_by_list` with the stores of each request's list in its row, as an array of ids."""
    told, lists = located_by_list(requests, stores)
    return told.join(lists, "list", "left").select("request_id", "scope", "city_used", F.coalesce("stores", F.array().cast("array<bigint>")).alias("stores"), "fallback", "distance_reliable", "warning")


def located_by_list(requests: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which stores a request is about, and what had to be given up for it: requests that name a list of stores, and the lists (list, stores), each made once for all that share it.

    requests (request_id, city, lat, lng, radius_km), stores (store_id, city, lat, lng). A point asks for the stores within the radius; a point and a city for those of them in the city,
    and for the city's stores where none of these has a place. A city without stores is shortened word by word from its end until one has some: every shorter form meets the
    cities in one equi join and the longest that has stores counts. Requests have request_id, scope (near, city or all), city_used, list (one that isn't among the lists is empty), fallback,
    distance_reliable, warning.
    """
    from basketry.functions.geo import DEGREE_KM, SLACK, box_cells, cell_of, level_of

    has_point = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    words = F.filter(F.split(place_key(F.col("city")), " "), lambda w: w != "")
    asked = requests.withColumn("near", has_point).withColumn("words", words).withColumn("named", F.size("words") > 0)
    # Requests with the same point, radius and city share a spot; one without a point has a name of its own, so that they don't meet in one task.
    spot = F.concat_ws("|", F.lit("near"), F.col("lat").cast("string"), F.col("lng").cast("string"), F.coalesce(F.col("radius_km").cast("string"), F.lit("")), F.array_join("words", " "))
    alone = F.concat(F.lit("#"), F.col("request_id").cast("string"))
    asked = asked.withColumn("spot", F.when(F.col("near"), spot).otherwise(alone))
    shops = stores.select("store_id", place_key(F.col("city")).alias("town"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), valid_place(F.col("lat"), F.col("lng")).alias("placed"))

    ladder = asked.where("named").select("request_id", "near", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.concat_ws(" ", F.slice("words", F.lit(1), n)))).alias("form"), F.size("words").alias("whole"))
    ladder = ladder.withColumn("n", F.size(F.split("form", " "))).where(~F.col("near") | (F.col("n") == F.col("whole")))
    towns = shops.groupBy("town").agg(F.array_sort(F.collect_list("store_id")).alias("in_town"), F.max("placed").alias("any_placed"))
    by_city = ladder.join(towns.drop("in_town"), F.col("form") == F.col("town")).groupBy("request_id").agg(F.max_by(F.struct("form", "any_placed", (F.col("n") < F.col("whole")).alias("shorter")), "n").alias("c"))

    tall = F.col("radius_km") * SLACK / DEGREE_KM
    wide = tall / F.greatest(F.lit(0.02), F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + tall))))
    circles = asked.where("near").dropDuplicates(["spot"]).withColumn("level", level_of(F.greatest(tall, wide) * 2))
    levels = circles.agg(F.array_sort(F.collect_set("level")).alias("l")).scalar()
    cells = circles.select("spot", "lat", "lng", "radius_km", "named", F.concat_ws(" ", "words").alias("want"), "level", F.explode(box_cells(F.col("level"), F.col("lng") - wide, F.col("lng") + wide, F.col("lat") - tall, F.col("lat") + tall)).alias("c")).select("*", "c.x", "c.y").drop("c")
    points = shops.where("placed").groupBy("s_lat", "s_lng", "town").agg(F.collect_list("store_id").alias("ids")).select("*", F.explode(levels).alias("level"))
    points = points.withColumn("x", cell_of(F.col("s_lng"), F.col("level"))).withColumn("y", cell_of(F.col("s_lat"), F.col("level")))
    close = cells.join(points, ["level", "x", "y"]).where(haversine_km(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")) <= F.col("radius_km"))
    close = close.where(~F.col("named") | (F.col("want") == F.col("town")))
    by_point = close.groupBy("spot").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("stores"))

    any_placed = shops.agg(F.coalesce(F.max("placed"), F.lit(False)).alias("p")).scalar()
    rows = asked.join(by_point.select("spot", F.lit(True).alias("reached")), "spot", "left").join(by_city, "request_id", "left")
    reached, in_city = F.col("reached").isNotNull(), F.col("c").isNotNull()
    to_city = F.col("near") & ~reached & F.col("named") & in_city & ~F.coalesce(F.col("c.any_placed"), F.lit(False))
    warning = (
        F.when(to_city, "matching city branches lack coordinates; city used")
        .when(F.col("near") & ~reached & ~F.col("named") & ~any_placed, "store coordinates unavailable; use city instead")
        .when(F.col("near") & ~reached & ~F.col("named"), F.concat(F.lit("no stores within "), F.col("radius_km").cast("int").cast("string"), F.lit(" km")))
        .when(~F.col("near") & F.col("named") & ~in_city, F.concat(F.lit("no stores matched city "), F.concat_ws(" ", "words")))
        .when(~F.col("near") & F.col("c.shorter"), F.concat(F.lit("no stores matched "), F.concat_ws(" ", "words"), F.lit("; using "), F.col("c.form")))
    )
    listed = F.when(F.col("near") & reached, F.col("spot")).when(to_city | (~F.col("near") & in_city), F.concat(F.lit("town|"), "c.form")).when(F.col("near") | F.col("named"), alone).otherwise("all")
    told = rows.select(
        "request_id", F.when(F.col("near") & ~to_city, "near").when(F.col("named"), "city").otherwise("all").alias("scope"), F.when(to_city | (~F.col("near") & in_city), F.col("c.form")).alias("city_used"), listed.alias("list"),
        (to_city | F.coalesce(~F.col("near") & F.col("c.shorter"), F.lit(False))).alias("fallback"), (F.col("near") & ~to_city).alias("distance_reliable"), warning.alias("warning"),
    )
    lists = by_point.select(F.col("spot").alias("list"), "stores").unionByName(towns.select(F.concat(F.lit("town|"), "town").alias("list"), F.col("in_town").alias("stores")))
    return told, lists.unionByName(shops.agg(F.array_sort(F.collect_list("store_id")).alias("stores")).select(F.lit("all").alias("list"), "stores"))
