"""Tag lists: arrays of (k, v), duplicates allowed; the first counts in lookups, the last in maps."""

from pyspark.sql import functions as F

#: Keys that say nothing about what a thing is.
UNINTERESTING = ("source", "source_ref", "source:ref", "history", "attribution", "created_by", "tiger:county", "tiger:tlid", "tiger:upload_uuid")

#: Keys by which a closed way is an area; whitelist: only with these values, blacklist: but with these.
AREA_ALL = (
    "building", "landuse", "amenity", "leisure", "boundary", "place", "shop", "tourism", "historic", "public_transport", "office", "building:part",
    "military", "ruins", "area:highway", "craft", "golf", "indoor",
)
AREA_WHITELIST = {
    "highway": ("services", "rest_area", "escape", "elevator"),
    "waterway": ("riverbank", "dock", "boatyard", "dam"),
    "barrier": ("city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"),
    "railway": ("station", "turntable", "roundhouse", "platform"),
    "power": ("plant", "substation", "generator", "transformer"),
}
AREA_BLACKLIST = {
    "natural": ("coastline", "cliff", "ridge", "arete", "tree_row"),
    "man_made": ("cutline", "embankment", "pipeline"),
    "aeroway": ("taxiway",),
}


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def find(tags, key):
    """Value of the first tag with the key; null without one."""
    return F.get(F.filter(_c(tags), lambda t: t["k"] == key), F.lit(0))["v"]


def find_or_empty(tags, key):
    return F.coalesce(find(tags, key), F.lit(""))


def has(tags, key):
    return F.coalesce(F.exists(_c(tags), lambda t: t["k"] == key), F.lit(False))


def as_map(tags):
    """Map with the last value of each key, whatever the session's policy for duplicate keys."""
    t = _c(tags)
    keys = F.array_distinct(F.transform(t, lambda x: x["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(t, lambda x: x["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def from_map(m):
    return F.transform(F.map_entries(_c(m)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def by_key_value(tags):
    return F.array_sort(_c(tags))


def interesting(tags, ignore=None):
    """Whether a tag says what the thing is; ignore: map of keys to drop, wholly ("true") or with this value."""

    def one(t):
        ok = ~t["k"].isin(*UNINTERESTING)
        if ignore is not None:
            v = F.try_element_at(_c(ignore), t["k"])
            ok = ok & ~F.coalesce((v == "true") | (v == t["v"]), F.lit(False))
        return ok

    return F.coalesce(F.exists(_c(tags), one), F.lit(False))


def area_tag(t):
    """Whether one tag makes a closed way an area."""
    hit = t["k"].isin(*AREA_ALL)
    for k, values in AREA_WHITELIST.items():
        hit = hit | ((t["k"] == k) & t["v"].isin(*values))
    for k, values in AREA_BLACKLIST.items():
        hit = hit | ((t["k"] == k) & ~t["v"].isin(*values))
    return hit & ~t["v"].isin("", "no")


def first_of_keys(tags):
    """The tags that lookups see: the first of each key."""
    t = _c(tags)
    return F.filter(t, lambda x, i: F.array_position(F.transform(t, lambda y: y["k"]), x["k"]) == i + 1)


def way_is_area(nodes, tags):
    """Whether a way, given its node refs (structs with ref), is an area: closed, over three nodes, and tagged so."""
    n, area = _c(nodes), find_or_empty(tags, "area")
    closed = (F.size(n) > 3) & (F.element_at(n, 1)["ref"] == F.element_at(n, -1)["ref"])
    rule = F.when(area == "no", False).when(area != "", True).otherwise(F.exists(first_of_keys(tags), area_tag))
    return F.coalesce(closed & rule, F.lit(False))


def relation_is_area(tags):
    return find_or_empty(tags, "type").isin("multipolygon", "boundary")


def changeset_fields(tags="tags"):
    """comment, created_by, locale, host, imagery_used, source and bot of a changeset."""
    names = ("comment", "created_by", "locale", "host", "imagery_used", "source")
    return [find_or_empty(tags, n).alias(n) for n in names] + [(find_or_empty(tags, "bot") == "yes").alias("bot")]
