"""Timestamps of mixed notations, precisions and zones to one UTC instant."""

from __future__ import annotations

import hashlib
import importlib.resources
import os
import re
import struct
import zoneinfo
from calendar import monthrange
from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: After so many seconds (400 years) days, weekdays and leap years come again in the same order, and with them every yearly rule of a zone.
CYCLE = 146_097 * 86_400

# Names of months and of zones that are no IANA names.
_MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
_LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTHS |= {m: i + 1 for i, m in enumerate(_LONG_MONTHS)}
_FIXED_ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200}


def zone_release() -> str:
    """The release of the zone data in use on this machine."""
    try:
        import tzdata

        packaged = tzdata.IANA_VERSION
    except ImportError:
        packaged = "unknown"
    for root in zoneinfo.TZPATH:
        if os.path.exists(os.path.join(root, "Europe", "London")):
            try:
                with open(os.path.join(root, "tzdata.zi")) as f:
                    return f.readline().split()[-1]
            except OSError:
                return "system"
    return packaged


def _zone_file(name: str) -> bytes:
    """The compiled file of a zone: from the system's folders or, as zoneinfo itself does, from the tzdata package."""
    for root in zoneinfo.TZPATH:
        path = os.path.join(root, *name.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    return importlib.resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()


def _changes(data: bytes) -> tuple[list[int], list[int], int, str]:
    """(instants, offsets from each on, offset before the first, rule for later years) of a compiled zone file (RFC 8536)."""

    def counts(at: int) -> tuple[int, ...]:
        if data[at : at + 4] != b"TZif":
            raise ValueError("no compiled zone file")
        return struct.unpack(">6l", data[at + 20 : at + 44])

    at, width = 0, 4
    if data[4:5] >= b"2":  # the second block has 64-bit instants and the rule
        utc, std, leap, times, types, chars = counts(0)
        at, width = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc, 8
    utc, std, leap, times, types, chars = counts(at)
    at += 44
    instants = list(struct.unpack(f">{times}{'q' if width == 8 else 'l'}", data[at : at + times * width]))
    kinds = data[at + times * width : at + times * (width + 1)]
    at += times * (width + 1)
    offsets = [struct.unpack(">lBB", data[at + 6 * i : at + 6 * i + 6]) for i in range(types)]
    at += types * 6 + chars + leap * (width + 4) + std + utc
    rule = data[at:].strip(b"\n").decode() if width == 8 else ""
    first = next((o for o, dst, _ in offsets if not dst), offsets[0][0])
    return instants, [offsets[k][0] for k in kinds], first, rule


_RULE = re.compile(r"(?:<[^>]+>|[A-Za-z]+)(?P<std>[+-]?[0-9:]+)(?:(?:<[^>]+>|[A-Za-z]+)(?P<dst>[+-]?[0-9:]+)?,(?P<start>[^,/]+)(?:/(?P<t1>[+-]?[0-9:]+))?,(?P<end>[^,/]+)(?:/(?P<t2>[+-]?[0-9:]+))?)?")


def _clock(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    parts = [int(x) for x in text.lstrip("+-").split(":")] + [0, 0]
    return sign * (parts[0] * 3600 + parts[1] * 60 + parts[2])


def _day(rule: str, year: int) -> int:
    """The day, counted from 1970, that a rule names in a year: Mm.w.d, Jn (no 29 February) or n."""
    if rule.startswith("M"):
        month, week, weekday = (int(x) for x in rule[1:].split("."))
        first, days = monthrange(year, month)
        day = 1 + (weekday - 1 - first) % 7 + 7 * (week - 1)  # monthrange counts from Monday, the rule from Sunday
        return (date(year, month, day if day <= days else day - 7) - date(1970, 1, 1)).days
    n = int(rule.lstrip("J"))
    start = (date(year, 1, 1) - date(1970, 1, 1)).days
    if rule.startswith("J"):
        return start + n - 1 + (1 if n >= 60 and monthrange(year, 2)[1] == 29 else 0)
    return start + n


@lru_cache(maxsize=None)
def _by_rule(rule: str, first_year: int) -> tuple[tuple[int, int], ...]:
    """(instant, offset from it on) of the changes that a yearly rule makes in 401 years, the least that repeat for ever."""
    m = _RULE.fullmatch(rule)
    if not m or not m["start"]:
        return ()
    std = -_clock(m["std"])
    dst = -_clock(m["dst"]) if m["dst"] else std + 3600
    out = []
    for year in range(first_year, first_year + 402):
        out.append((_day(m["start"], year) * 86400 + _clock(m["t1"] or "2") - std, dst))
        out.append((_day(m["end"], year) * 86400 + _clock(m["t2"] or "2") - dst, std))
    return tuple(sorted(out))


def _table(name: str) -> tuple[np.ndarray, np.ndarray]:
    """(wall, offset): the wall seconds from which each offset holds.

    An offset takes over at the later of the two wall times of its change: a
    wall time that occurs twice then has the offset before, which is its
    earlier instant, and a skipped one is read with the offset before as well.
    """
    instants, offsets, first, rule = _changes(_zone_file(name))
    if rule:
        since = instants[-1] if instants else -(2**40)
        year = 1970 + max(0, since) // 31_556_952
        later = [(t, o) for t, o in _by_rule(rule, int(year)) if t > since]
        instants += [t for t, _ in later]
        offsets += [o for _, o in later]
    walls, out, before = [-(2**62)], [first], first
    for t, o in zip(instants, offsets, strict=True):
        if o != before:
            walls.append(t + max(before, o))
            out.append(o)
            before = o
    return np.array(walls, dtype=np.int64), np.array(out, dtype=np.int64)


@dataclass(frozen=True)
class ZoneTables:
    """The transition tables of all zones under one version: the release of the zone data and a digest of the tables.

    They are built once, on the driver, and go to every worker as they are, so
    two machines with different zone data cannot disagree. save() and load()
    keep them beside the converted data, to convert later loads by the same
    version. About 5 MB, whatever the data.
    """

    version: str
    zones: dict[str, tuple[np.ndarray, np.ndarray]] = field(repr=False)

    def offsets(self, name: str, wall: np.ndarray) -> np.ndarray | None:
        """The offsets of a zone at wall seconds; None for an unknown name."""
        key = name.strip().lower()
        if key in _FIXED_ZONES:
            return np.full(len(wall), _FIXED_ZONES[key], dtype=np.int64)
        if key not in self.zones:
            return None
        walls, offsets = self.zones[key]
        if walls[-1] > CYCLE // 2:  # a yearly rule, listed for 400 years: beyond them the same years come again
            wall = wall - np.maximum(0, -((walls[-1] - wall) // CYCLE)) * CYCLE
        return offsets[np.searchsorted(walls, wall, side="right") - 1]

    def save(self, spark: SparkSession, path: str) -> None:
        """Append the tables to the Parquet folder path, under their version."""
        rows = [(self.version, k, w.tolist(), o.tolist()) for k, (w, o) in sorted(self.zones.items())]
        spark.createDataFrame(rows, "version string, zone string, wall array<bigint>, utc_offset array<bigint>").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: str) -> ZoneTables:
        rows = spark.read.parquet(path).where(F.col("version") == version).collect()  # the zones of one version
        if not rows:
            raise ValueError(f"no zone tables of version {version}")
        return ZoneTables(version, {r["zone"]: (np.array(r["wall"], dtype=np.int64), np.array(r["utc_offset"], dtype=np.int64)) for r in rows})


@lru_cache(maxsize=1)
def zone_tables() -> ZoneTables:
    """The tables of this machine's zone data."""
    zones, digest = {}, hashlib.sha256()
    for name in sorted(zoneinfo.available_timezones()):
        try:
            zones[name.lower()] = table = _table(name)
        except (OSError, ValueError):
            continue
        digest.update(name.encode() + table[0].tobytes() + table[1].tobytes())
    return ZoneTables(f"{zone_release()}-{digest.hexdigest()[:12]}", zones)


#: Each character's class: 9 for digits, a for letters, the character itself otherwise.
_CLASS = {ord(c): "9" for c in "0123456789"} | {i: "a" for i in range(128) if chr(i).isalpha()}


def shape_mask(text: str) -> str:
    return text.translate(_CLASS)


_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa))?"
_ZONE = r"(?: ?(?P<off>[+-]99(?::?99)?)(?: ?\[(?P<in>[a9/_+-]+)\])?|(?: ?(?<!a)(?P<z>a)| (?P<zone>a[a9/_+-]*)|\[(?P<only>[a9/_+-]+)\]))?"
_AP_TIME = _TIME.replace("(?: ?(?P<ap>aa))?", " ?(?P<ap>aa)")
_PLAIN_TIME = _TIME.replace("(?: ?(?P<ap>aa))?", "")
# the notations, as patterns over masks; the first that matches holds
_SHAPES = [
    (kind, re.compile(rf"\A{p}\Z"))
    for kind, p in (
        ("epoch", r"(?P<n>9{10}|9{13}|9{16})(?:\.(?P<f>9+))?"),
        ("ymd", rf"(?P<y>9999)-(?P<m>99?)-(?P<d>99?)(?:(?:a| +){_AP_TIME}{_ZONE})"),
        ("ymd", rf"(?P<y>9999)-(?P<m>99?)-(?P<d>99?)(?:(?:a| +){_PLAIN_TIME}{_ZONE})"),
        ("ymd", rf"(?P<y>9999)(?P<m>99)(?P<d>99)a?(?P<H>99)(?P<M>99)(?P<S>99)(?:\.(?P<f>9+))?{_ZONE}"),
        ("yfirst", rf"(?P<y>9999)[/.](?P<p>99?)[/.](?P<q>99?)(?:a| +){_AP_TIME}{_ZONE}"),
        ("yfirst", rf"(?P<y>9999)[/.](?P<p>99?)[/.](?P<q>99?)(?:a| +){_PLAIN_TIME}{_ZONE}"),
        ("ylast", rf"(?P<p>99?)[/.](?P<q>99?)[/.](?P<y>9999),? +{_AP_TIME}{_ZONE}"),
        ("ylast", rf"(?P<p>99?)[/.](?P<q>99?)[/.](?P<y>9999),? +{_PLAIN_TIME}{_ZONE}"),
        ("named", rf"(?:a+,? +)?(?P<d>99?)[ -](?P<mon>aaa+)[ -](?P<y>9999),? +{_AP_TIME}{_ZONE}"),
        ("named", rf"(?:a+,? +)?(?P<d>99?)[ -](?P<mon>aaa+)[ -](?P<y>9999),? +{_PLAIN_TIME}{_ZONE}"),
        ("named", rf"(?:a+, +)?(?P<mon>aaa+) (?P<d>99?),? +(?P<y>9999),? +{_AP_TIME}{_ZONE}"),
        ("named", rf"(?:a+, +)?(?P<mon>aaa+) (?P<d>99?),? +(?P<y>9999),? +{_PLAIN_TIME}{_ZONE}"),
    )
]


#: Masks up to this length are remembered with their parsers; longer ones are matched anew each time.
CACHED_MASK = 200


@lru_cache(maxsize=65536)
def parser_for(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """(kind, {field: (start, end)}): the parser of a mask, found once per distinct mask; None if it names no instant.

    All texts of one mask have their fields at the same places.
    """
    for kind, pattern in _SHAPES:
        if m := pattern.match(mask):
            return kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _numbers(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _micros(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    """The fraction in microseconds; digits beyond the sixth are cut off."""
    if span is None:
        return np.zeros(len(chars), dtype=np.int64)
    a, b = span
    used = min(6, b - a)
    return _numbers(chars, (a, a + used)) * 10 ** (6 - used)


def convert(texts: list[str], zones: list[str | None], orders: list[str | None], tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """(micros, valid) of texts that share one mask, computed column by column."""
    n = len(texts)
    none = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    mask = shape_mask(texts[0])
    parser = parser_for(mask) if len(mask) <= CACHED_MASK else parser_for.__wrapped__(mask)
    if parser is None:
        return none
    kind, span = parser
    width = len(texts[0])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(n, width)
    if kind == "epoch":
        digits = span["n"][1] - span["n"][0]
        value, fraction = _numbers(chars, span["n"]), span.get("f")
        if digits == 10:
            return value * 1_000_000 + _micros(chars, fraction), np.ones(n, dtype=bool)
        if digits == 13:
            return value * 1_000 + _micros(chars, fraction) // 1_000, np.ones(n, dtype=bool)
        return value, np.ones(n, dtype=bool)
    part = lambda k: _numbers(chars, span[k]) if k in span else np.zeros(n, dtype=np.int64)

    def words(k: str) -> tuple[np.ndarray, list[str]]:
        a, b = span[k]
        uniques, at = np.unique(np.array([t[a:b].lower() for t in texts]), return_inverse=True)
        return at, [str(u) for u in uniques]

    y = part("y")
    if kind in ("ymd",):
        m, d = part("m"), part("d")
    elif kind == "named":
        at, names = words("mon")
        m, d = np.array([_MONTHS.get(x, 0) for x in names])[at], part("d")
    else:
        p, q = part("p"), part("q")
        day_first = np.array([o == "dmy" for o in orders])
        if kind == "yfirst":
            # year, then month and day, whatever the order of dates that end in the year
            m, d = p, q
        else:
            m, d = np.where(day_first, q, p), np.where(day_first, p, q)
    hour, minute, second = part("H"), part("M"), part("S")
    ok = np.ones(n, dtype=bool)
    if "ap" in span:
        at, names = words("ap")
        half = np.array([{"am": 0, "pm": 12}.get(x, -1) for x in names])[at]
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    ok &= (m >= 1) & (m <= 12) & (y >= 1)
    safe_m = np.where(ok, m, 1)
    ok &= (d >= 1) & (d <= _MONTH_DAYS[safe_m] + ((safe_m == 2) & leap)) & (hour < 24) & (minute < 60) & (second < 60)
    months = ((np.where(ok, y, 1970) - 1970) * 12 + safe_m - 1).astype("datetime64[M]")
    wall = (months.astype("datetime64[D]").astype(np.int64) + d - 1) * 86400 + hour * 3600 + minute * 60 + second
    if "off" in span:
        a, b = span["off"]
        sign = np.where(chars[:, a] == ord("-"), -1, 1)
        h = _numbers(chars, (a + 1, a + 3))
        mm = _numbers(chars, (b - 2, b)) if b - a > 3 else np.zeros(n, dtype=np.int64)
        ok &= (h < 24) & (mm < 60)
        utc = wall - sign * (h * 3600 + mm * 60)
    else:
        k = next((x for x in ("z", "zone", "only") if x in span), None)
        if k:
            at, names = words(k)
        else:
            names, at = np.unique(np.array([z if z is not None else "utc" for z in zones]), return_inverse=True)
        utc = np.zeros(n, dtype=np.int64)
        for i, name in enumerate(names):
            rows = at == i
            offset = tables.offsets(str(name), wall[rows])
            if offset is None:
                ok[rows] = False
                continue
            utc[rows] = wall[rows] - offset
    return utc * 1_000_000 + _micros(chars, span.get("f")), ok


def to_micros(text: pd.Series, zone: pd.Series, order: pd.Series, tables: ZoneTables | None = None) -> pd.Series:
    """Microseconds since 1970 of texts of any notation and length; null where a text names no instant."""
    tables = tables or zone_tables()
    out = np.zeros(len(text), dtype=np.int64)
    valid = np.zeros(len(text), dtype=bool)
    groups: dict[str, list[int]] = {}
    values, zones, orders = text.tolist(), zone.tolist(), order.tolist()
    for i, t in enumerate(values):
        if isinstance(t, str):
            t = values[i] = t.strip()
            if t:
                groups.setdefault(t.translate(_CLASS), []).append(i)
    for rows in groups.values():
        got, ok = convert([values[i] for i in rows], [zones[i] for i in rows], [orders[i] for i in rows], tables)
        out[rows], valid[rows] = got, ok
    return pd.Series(pd.array(np.where(valid, out, 0), dtype="Int64")).mask(~valid)


_sent: dict[tuple[str, str], object] = {}


def _utc_micros(spark: SparkSession, tables: ZoneTables):
    """The conversion as a column function; the tables go to each executor once."""
    key = (spark.sparkContext.applicationId, tables.version)
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(tables)  # a fixed size, see ZoneTables
    sent = _sent[key]

    @F.pandas_udf(LongType())
    def utc_micros(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        return to_micros(text, zone, order, sent.value)

    return utc_micros


#: The one form that needs no normalising.
CANONICAL = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z\z"


def client_clock(clients: DataFrame) -> DataFrame:
    """(client, zone, date_order), one row per client; an unknown zone name makes the client's wall times nameless."""
    return clients.where("client is not null").groupBy("client").agg(F.min(F.struct("zone", "date_order")).alias("c")).select("client", "c.zone", "c.date_order")


def normalised(df: DataFrame, columns: list[str], clients: DataFrame, tables: ZoneTables | None = None) -> DataFrame:
    """df with `<column>_utc_micros` for each of columns: the instant, or null where the text names none; and `zone_data`, the version of the zone tables.

    A zone or offset in the text holds; else the wall time is that of the
    client's zone (UTC for a null zone or an unknown client), by `tables` or
    those of the driver's zone data. See _table for wall times that occur twice
    or never; years after the last listed change follow the zone's yearly rule. Digits beyond microseconds are cut.
    df needs the column client; clients is joined by size.
    """
    both = df.join(client_clock(clients).withColumnsRenamed({"zone": "__zone", "date_order": "__order"}), "client", "left")
    tables = tables or zone_tables()
    utc_micros = _utc_micros(df.sparkSession, tables)
    own = [F.col(f"`{c}`") for c in df.columns if c != "zone_data"]
    return both.select(*own, *[utc_micros(F.col(f"`{c}`"), F.col("__zone"), F.col("__order")).alias(f"{c}_utc_micros") for c in columns], F.lit(tables.version).alias("zone_data"))


def uncanonical_instants(df: DataFrame, record_table: str, key: str, fields: list[str], clients: DataFrame) -> DataFrame:
    """(record_table, record_id, field, utc_micros) of the values that name an instant in another form than CANONICAL.

    Canonical texts never leave the JVM. Copies of a record give one row.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = df.select(F.col(key).alias("record_id"), "client", F.explode(cells).alias("c")).select("record_id", "client", "c.field", "c.value")
    rows = rows.where(F.col("value").isNotNull() & F.col("record_id").isNotNull() & ~F.col("value").rlike(CANONICAL))
    out = normalised(rows, ["value"], clients).where("value_utc_micros is not null")
    return out.select(F.lit(record_table).alias("record_table"), "record_id", "field", F.col("value_utc_micros").alias("utc_micros")).distinct()
