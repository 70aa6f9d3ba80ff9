"""Times, state files and paths of change feeds."""

from pyspark.sql import functions as F

from .. import schema


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def note_date(text):
    return F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd HH:mm:ss z"))


def feed_time(text):
    """Time in any of the layouts that feeds use; backslashes before colons are dropped."""
    t = F.replace(_c(text), F.lit("\\"), F.lit(""))
    layouts = ("yyyy-MM-dd HH:mm:ss.SSSSSSSSS XXX", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS xx", "yyyy-MM-dd HH:mm:ss XXX", "yyyy-MM-dd'T'HH:mm:ssX")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(x)) for x in layouts), F.try_to_timestamp(t))


def interval_state(text):
    """State struct of a minute, hour or day state file: key=value lines, # comments."""
    m = F.str_to_map(F.regexp_replace(F.regexp_replace(_c(text), r"^\s+|\s+$", ""), r"\s*[\r\n]+\s*", "\n"), F.lit("\n"), F.lit("="))
    num = lambda k: F.try_element_at(m, F.lit(k)).try_cast("bigint")
    return F.struct(
        num("sequenceNumber").alias("seq"), feed_time(F.try_element_at(m, F.lit("timestamp"))).alias("timestamp"), num("txnMax").alias("txn_max"), num("txnMaxQueried").alias("txn_max_queried")
    )


def changeset_state(text, seq=None):
    """State struct of a changeset state file: line 2 the time, line 3 the sequence. The current state names the next one;
    an older file is known by its own number, given as seq."""
    lines = F.split(_c(text), "\n")
    when = F.regexp_replace(F.get(lines, F.lit(1)), r"^last_run:\s*", "")
    at = F.regexp_replace(F.get(lines, F.lit(2)), r"^sequence:\s*", "").try_cast("bigint")
    return F.struct((at + 1 if seq is None else _c(seq).cast("bigint")).alias("seq"), feed_time(when).alias("timestamp"))


def feed_path(base, kind, seq, suffix=".osc.gz"):
    """Path of a feed's file: the sequence number in three groups of three digits."""
    n = _c(seq).cast("bigint")
    group = lambda d: F.lpad((F.floor(n / d) % 1000).cast("string"), 3, "0")
    return F.concat(F.lit(f"{base}/replication/{kind}/"), F.concat_ws("/", group(1_000_000), group(1000), group(1)), F.lit(suffix))


def committed_at(committed="committed", timestamp="timestamp"):
    return F.coalesce(_c(committed), _c(timestamp))


def effective_us(committed, timestamp, eps=0):
    """When an element took effect, in microseconds: its commit time if known, else its timestamp plus eps."""
    cm = F.unix_micros(_c(committed))
    return F.when(cm >= schema.COMMIT_TIMES_FROM_US, cm).otherwise(F.unix_micros(_c(timestamp)) + eps)
