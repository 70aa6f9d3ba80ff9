"""Packed, textual and typed identifiers of elements and features."""

from pyspark.sql import functions as F

#: Type codes, bits 56 to 62 of a packed id.
TYPE_CODES = {"bounds": 0x08, "node": 0x10, "way": 0x20, "relation": 0x30, "changeset": 0x40, "note": 0x50, "user": 0x60}


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def type_code(kind):
    kind, out = _c(kind), F.lit(None).cast("bigint")
    for name, code in TYPE_CODES.items():
        out = F.when(kind == name, F.lit(code).cast("bigint")).otherwise(out)
    return out


def type_name(packed):
    code, out = F.shiftright(_c(packed), 56).bitwiseAND(F.lit(0x7F)), F.lit(None).cast("string")
    for name, value in TYPE_CODES.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def pack(kind, ref, version=None):
    """(type, ref, version) as one long whose order is theirs; ref below 2**40, version modulo 2**16."""
    v = F.lit(0).cast("bigint") if version is None else F.coalesce(_c(version), F.lit(0)).cast("bigint").bitwiseAND(F.lit(65535))
    return F.shiftleft(type_code(kind), 56).bitwiseOR(F.shiftleft(_c(ref).cast("bigint"), 16)).bitwiseOR(v)


def ref_of(packed):
    return F.shiftright(_c(packed).bitwiseAND(F.lit(0x00FFFFFFFFFF0000)), 16)


def version_of(packed):
    return _c(packed).bitwiseAND(F.lit(65535)).cast("int")


def feature_of(packed):
    """The packed id without its version."""
    return F.shiftleft(F.shiftright(_c(packed), 16), 16)


def feature_text(packed):
    return F.concat_ws("/", F.coalesce(type_name(packed), F.lit("unknown")), ref_of(packed).cast("string"))


def element_text(packed):
    v = version_of(packed)
    return F.concat(feature_text(packed), F.lit(":"), F.when(v == 0, "-").otherwise(v.cast("string")))


_TEXT = r"^(bounds|node|way|relation|changeset|note|user)/(-?[0-9]+)(?::([0-9]+|-))?$"


def parse_text(text):
    """Packed id of type/ref or type/ref:version (- for none); null if malformed."""
    text = _c(text)
    part = lambda i: F.regexp_extract(text, _TEXT, i)
    v = F.when(part(3).isin("", "-"), F.lit(0)).otherwise(part(3).try_cast("int"))
    return F.when(text.rlike(_TEXT), pack(part(1), part(2).try_cast("bigint"), v))
