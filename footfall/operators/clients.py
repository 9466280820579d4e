"""Who sent a request: client address, country and bots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.addresses import (
    address_bits,
    ip_in_cidr,
    network_bits,
    normalize_ip,
    resolve_client_ip,
    Trust,
    trust_entries,
)
from footfall.functions.agents import is_bot
from footfall.functions.text import none_if_empty, trim_blanks
from footfall.model import COUNTRY_MAX

# Country headers as columns, in order of preference.
COUNTRY_HEADERS = ["cf_ipcountry", "x_country_code", "cloudfront_viewer_country"]


def server_country(remote: Column, headers: list[Column], trust: Trust) -> Column:
    """Upper-case country header, only from a trusted peer."""
    if trust is False or trust is None:
        return F.lit(None).cast("string")
    chosen = trim_blanks(F.coalesce(*[none_if_empty(h) for h in headers]))
    usable = F.length(chosen) <= COUNTRY_MAX
    if isinstance(trust, (str, list)):
        usable = usable & ip_in_cidr(remote, trust_entries(trust))
    return F.when(usable, none_if_empty(F.upper(chosen)))


def resolve_clients(requests: DataFrame, trust: Trust = False) -> DataFrame:
    """Adds ``client_ip`` and ``country`` from the request headers.

    ``requests`` has remote_address, x_forwarded_for and the country header columns. The
    result holds the raw address for rate limiting; only its masked form is ever stored.
    """
    return requests.withColumns(
        {
            "client_ip": resolve_client_ip(
                F.col("remote_address"), F.col("x_forwarded_for"), trust
            ),
            "country": server_country(
                F.col("remote_address"), [F.col(h) for h in COUNTRY_HEADERS], trust
            ),
        }
    )


def mark_listed(rows: DataFrame, networks: DataFrame, ip: str = "ip", entry: str = "entry") -> DataFrame:
    """Adds ``listed``: whether an address equals an entry of a table or lies in one of its networks.

    For trust lists too long to be literals (`ip_in_cidr`). A network becomes the text of its leading bits,
    an address one such text for every length that the table has (at most 163, read by the driver), so the
    range test is a join by equality. Each distinct address is looked up once.
    """
    entries = networks.select(F.trim(F.col(entry)).alias("entry")).where("entry <> ''")
    fixed = network_bits(F.col("entry"))
    exact = F.when(~F.col("entry").contains("/"), F.concat(F.lit("="), normalize_ip(F.col("entry"))))
    wanted = entries.select(F.coalesce(exact, fixed).alias("key")).where("key IS NOT NULL").distinct()
    lengths = wanted.where("key NOT LIKE '=%'").select(F.left("key", F.lit(1)), F.length("key")).distinct().collect()
    seen = rows.select(normalize_ip(F.col(ip)).alias("text")).where("text <> ''").distinct()
    bits = address_bits(F.col("text"))
    keys = [F.concat(F.lit("="), "text")] + [
        F.when(F.col("bits").startswith(family), F.left("bits", F.lit(length))) for family, length in sorted(lengths)
    ]
    tried = seen.select("text", bits.alias("bits")).select("text", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    # Rebalanced, so that the join back shuffles both sides and can split a busy address.
    found = tried.join(wanted, "key", "left_semi").select(F.col("text").alias("_listed")).distinct().hint("rebalance")
    return (
        rows.withColumn("_text", normalize_ip(F.col(ip)))
        .join(found, F.col("_text") == F.col("_listed"), "left")
        .withColumn("listed", F.col("_listed").isNotNull())
        .drop("_text", "_listed")
    )


def resolve_country(
    server: Column, client: Column, trust_client_country: bool = False
) -> Column:
    """The server's country, else the client's claim where that is opted into."""
    if not trust_client_country:
        return server
    return F.coalesce(server, none_if_empty(client))


def filter_bots(requests: DataFrame, ua: str = "user_agent") -> DataFrame:
    """Drop requests of known automated clients; a missing user agent is kept."""
    return requests.where(~is_bot(F.col(ua)))
