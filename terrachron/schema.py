"""Column types of the tables; null stands for what the formats leave out."""

TAGS = "array<struct<k: string, v: string>>"
WAY_NODES = "array<struct<ref: bigint, version: int, changeset: bigint, lat: double, lon: double>>"
UPDATES = "array<struct<index: int, version: int, timestamp: timestamp, changeset: bigint, lat: double, lon: double, reverse: boolean>>"
BOUNDS = "struct<minlat: double, maxlat: double, minlon: double, maxlon: double>"
MEMBERS = f"array<struct<type: string, ref: bigint, role: string, version: int, changeset: bigint, lat: double, lon: double, orientation: tinyint, nodes: {WAY_NODES}>>"
_META = f"user string, uid bigint, visible boolean, version int, changeset bigint, timestamp timestamp, tags {TAGS}, committed timestamp"
NODES = f"id bigint, lat double, lon double, {_META}"
WAYS = f"id bigint, {_META}, nodes {WAY_NODES}, updates {UPDATES}, bounds {BOUNDS}"
RELATIONS = f"id bigint, {_META}, members {MEMBERS}, updates {UPDATES}, bounds {BOUNDS}"
CHANGESETS = (
    "id bigint, user string, uid bigint, created_at timestamp, closed_at timestamp, open boolean, num_changes int, min_lat double, max_lat double, "
    f"min_lon double, max_lon double, comments_count int, tags {TAGS}, discussion array<struct<user: string, uid: bigint, date: timestamp, text: string>>"
)
NOTES = (
    "id bigint, lat double, lon double, url string, comment_url string, close_url string, reopen_url string, date_created timestamp, date_closed timestamp, "
    "status string, comments array<struct<date: timestamp, uid: bigint, user: string, user_url: string, action: string, text: string, html: string>>"
)
USERS = (
    "id bigint, name string, description string, img struct<href: string>, changesets struct<count: int>, traces struct<count: int>, "
    "home struct<lat: double, lon: double, zoom: int>, languages array<string>, blocks struct<received: struct<count: int, active: int>>, "
    "messages struct<received: struct<count: int, unread: int>, sent: struct<count: int>>, created_at timestamp"
)
STATES = "seq bigint, timestamp timestamp, txn_max bigint, txn_max_queried bigint"
TABLES = {"node": NODES, "way": WAYS, "relation": RELATIONS, "changeset": CHANGESETS, "note": NOTES, "user": USERS}

#: The data's attribution, and when commit times began to be known.
COPYRIGHT = "OpenStreetMap and contributors"
ATTRIBUTION = "http://www.openstreetmap.org/copyright"
LICENSE = "http://opendatacommons.org/licenses/odbl/1-0/"
COMMIT_TIMES_FROM = "2012-09-12 09:30:03"
COMMIT_TIMES_FROM_US = 1_347_442_203_000_000
