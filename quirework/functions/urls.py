"""FLT11: public HTTPS addresses, checked without any network."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: endings of hosts that aren't public.
BLOCKED = (".local", ".localhost", ".internal", ".test", ".invalid", ".example", ".home.arpa", ".onion")
#: Characters of a path that stay as they are.
KEPT = "^[A-Za-z0-9/%:@!$&'()*+,;=._~-]$"
LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


@F.pandas_udf(StringType())
def idna(hosts: pd.Series) -> pd.Series:
    def one(h: str | None) -> str | None:
        try:
            return None if h is None else h.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return hosts.map(one)


#: A part of an IPv4 address; a host of larger numbers is a name.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def validate_urls(pages: DataFrame, column: str = "url") -> DataFrame:
    """pages with host, path and reason. ASCII hosts stay in Spark's own functions; only others meet Python."""
    u = F.col(column)
    authority = F.regexp_extract(u, r"^https://([^/?#]*)", 1)
    port = F.regexp_extract(authority, ":([0-9]*)$", 1)
    raw = F.lower(F.regexp_replace(authority, ":[0-9]*$", ""))
    ascii_ = raw.rlike("^[\\x00-\\x7f]*$")
    checked = pages.withColumn("_raw", raw).withColumn("_wide", F.when(~ascii_, raw))
    return judge(checked, u, authority, port)


def judge(rows: DataFrame, u, authority, port) -> DataFrame:
    wide = rows.where("_wide IS NOT NULL").withColumn("host", idna("_wide"))
    plain = rows.where("_wide IS NULL").withColumn("host", F.col("_raw"))
    out = plain.unionByName(wide)
    host = F.coalesce("host", F.lit(""))
    blocked = F.lit(False)
    for b in BLOCKED:
        blocked = blocked | host.endswith(b)
    reason = (
        F.when(u.isNull() | ~F.length(u).between(10, 1800) | u.rlike("[\\x00-\\x20\\x7f\\\\]"), "length or characters")
        .when(~u.startswith("https://") | (authority == ""), "not HTTPS")
        .when(authority.contains("@"), "credentials")
        .when(u.rlike("[?]."), "query")
        .when(u.rlike("#."), "fragment")
        .when((port != "") & (port != "443"), "port")
        .when(host.endswith("."), "trailing dot")
        .when(u.contains("%") | authority.rlike("[\\[\\]]"), "encoded or bracketed")
        .when(host.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "IP address")
        .when((F.length(host) > 253) | ~host.contains(".") | blocked, "not public")
        .when(~host.rlike(rf"^{LABEL}(?:\.{LABEL})*$"), "label")
    )
    path = F.regexp_extract(u, r"^https://[^/?#]*([^?#]*)", 1)
    coded = F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), lambda ch: F.when(ch.rlike(KEPT), ch).otherwise(F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", r"%$1")))
    safe = F.when(path == "", "/").otherwise(F.array_join(coded, ""))
    return out.withColumn("reason", reason).withColumn("path", F.when(F.col("reason").isNull(), safe)).withColumn("host", F.when(F.col("reason").isNull(), F.col("host"))).drop("_raw", "_wide")
