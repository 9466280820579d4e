import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions.addresses import ip_in_cidr, is_valid_ip, mask_ip, normalize_ip, resolve_client_ip
from footfall.functions.agents import is_bot, parse_browser, parse_device
from footfall.operators import clients, rates
from footfall.streaming import rates as stream_rates


def mapped(spark, column, *values):
    """A column function over single text values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r[0] for r in df.orderBy("n").select(column(F.col("v"))).collect()]


def test_mask_ip(spark):
    cases = {
        "192.168.1.42": "192.168.1.0",
        "10.0.0.254": "10.0.0.0",
        "172.16.50.123": "172.16.50.0",
        "127.0.0.1:8080": "127.0.0.0",
        " 127.0.0.1 ": "127.0.0.0",
        "::ffff:192.168.1.42": "192.168.1.0",
        "::FFFF:192.168.1.42": "192.168.1.0",
        "[::ffff:10.0.0.1]:3000": "10.0.0.0",
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334": "2001:db8:85a3::",
        "2001:db8:85a3::1": "2001:db8:85a3::",
        "2001:db8::1": "2001:db8::",
        "fe80::1ff:fe23:4567:890a": "fe80::",
        "::1": "::",
        "[2001:db8:abcd::1]:443": "2001:db8:abcd::",
        "0:0:5::1": "0:0:5::",
        "a:0:c::": "a:0:c::",
        "64:ff9b::1.2.3.4": "64:ff9b::",
        "1::2::3": None,
        "1:2:3": None,
        "1:2:3:4:5:6:7:8:9": None,
        "unknown": "unknown",
        "": None,
        None: None,
    }
    assert mapped(spark, mask_ip, *cases) == list(cases.values())


def test_normalize_and_validate(spark):
    cases = {
        "::ffff:192.0.2.1": "192.0.2.1",
        "192.0.2.1:8080": "192.0.2.1",
        "[2001:db8::1]:8080": "2001:db8::1",
        "2001:0DB8::1": "2001:0db8::1",
        "::FFFF:1.2.3.4": "::ffff:1.2.3.4",
        None: "",
    }
    assert mapped(spark, normalize_ip, *cases) == list(cases.values())
    good = ["1.2.3.4", "::", "1::", "::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7::"]
    bad = ["01.2.3.4", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8::", "1::2::3", "12345::", "256.1.1.1", "", ":::", "x"]
    assert mapped(spark, is_valid_ip, *good) == [True] * len(good)
    assert mapped(spark, is_valid_ip, *bad) == [False] * len(bad)


@pytest.mark.parametrize(
    "peer, forwarded, trust, expected",
    [
        ("203.0.113.1", "198.51.100.1", False, "203.0.113.1"),
        ("10.0.0.1", "203.0.113.50, 198.51.100.1", 1, "198.51.100.1"),
        ("10.0.0.1", "203.0.113.50, 198.51.100.1", True, "198.51.100.1"),
        ("10.0.0.2", "203.0.113.50, 198.51.100.1", 2, "203.0.113.50"),
        ("10.0.0.1", "203.0.113.50", 3, "10.0.0.1"),
        ("198.51.100.20", "203.0.113.50", ["10.0.0.1", "10.0.0.2"], "198.51.100.20"),
        ("10.0.0.1", "203.0.113.50, 10.0.0.2", ["10.0.0.1", "10.0.0.2"], "203.0.113.50"),
        ("10.0.0.1", "invalid-ip, not-an-address, 999.999.999.999", 1, "10.0.0.1"),
        ("10.240.0.5", "203.0.113.195", ["10.0.0.0/8"], "203.0.113.195"),
        ("192.168.1.100", "203.0.113.195", "10.0.0.0/8", "192.168.1.100"),
        ("2001:db8:abcd::1", "203.0.113.195", ["2001:db8::/32"], "203.0.113.195"),
        ("2001:db8:abcd::1", "203.0.113.195", ["2001:db8:8000::/33"], "203.0.113.195"),
        ("2001:db8:4bcd::1", "203.0.113.195", ["2001:db8:8000::/33"], "2001:db8:4bcd::1"),
        ("10.0.0.1", "10.0.0.2", ["10.0.0.0/8"], "10.0.0.2"),
        (None, "1.2.3.4", 1, "1.2.3.4"),
        ("10.0.0.1", None, 1, "10.0.0.1"),
        ("10.0.0.1", " , ", 1, "10.0.0.1"),
    ],
)
def test_client_ip(spark, peer, forwarded, trust, expected):
    df = spark.createDataFrame([(peer, forwarded)], "a string, b string")
    assert df.select(resolve_client_ip(F.col("a"), F.col("b"), trust)).first()[0] == expected


def test_cidr(spark):
    def inside(ip, *entries):
        return mapped(spark, lambda c: ip_in_cidr(c, list(entries)), ip) == [True]

    assert inside("10.1.2.3", "10.0.0.0/8") and not inside("11.1.2.3", "10.0.0.0/8")
    assert inside("1.2.3.4", "0.0.0.0/0") and inside("1.2.3.4", "1.2.3.4/32")
    assert inside("1.2.3.4", "1.2.3.4") and not inside("1.2.3.4", "1.2.3.5/32")
    assert inside("::1", "::/0") and inside("2001:db8::1", "2001:0db8::/31")
    assert not inside("1.2.3.4", "1.2.3.0/33") and not inside("1.2.3.4", "x/8") and not inside("", "::/0")


def test_country(spark):
    schema = "remote_address string, x_forwarded_for string, cf_ipcountry string, x_country_code string, cloudfront_viewer_country string"

    def country(trust, peer="10.0.0.1", cf=None, code=None, front=None):
        df = spark.createDataFrame([(peer, None, cf, code, front)], schema)
        return clients.resolve_clients(df, trust).first().country

    assert country(False, cf="fr") is None
    assert country(1, cf="fr") == "FR"
    assert country(1, cf="", code=" us ") == "US"
    assert country(1, cf="x" * 17, code="us") is None
    assert country(["10.0.0.0/8"], front="gb") == "GB"
    assert country(["10.0.0.0/8"], peer="9.9.9.9", front="gb") is None


def test_agents(spark):
    cases = {
        "": ("Unknown", "Unknown"),
        None: ("Unknown", "Unknown"),
        "Chrome/120 Safari/537 Edg/120": ("Edge", "Desktop"),
        "Chrome/120 Safari/537 OPR/1": ("Opera", "Desktop"),
        "Chrome/120 Mobile Safari/537": ("Chrome", "Mobile"),
        "iPad Safari/605 mobile": ("Safari", "Tablet"),
        "ANDROID Firefox/1": ("Firefox", "Mobile"),
        "chrome": ("Other", "Desktop"),
    }
    assert list(zip(mapped(spark, parse_browser, *cases), mapped(spark, parse_device, *cases))) == list(cases.values())
    agents = ["Googlebot/2.1", "curl/8", "HeadlessChrome/1", None, "", "Mozilla/5.0 Chrome/120"]
    assert mapped(spark, is_bot, *agents) == [True, True, True, False, False, False]


def limit_one_by_one(requests, limit, window_ms):
    """The sliding log, one request at a time."""
    logs, verdicts = {}, {}
    for ip, ts, number in sorted(requests, key=lambda r: (r[1], r[2])):
        now = int((ts - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
        log = logs.setdefault(ip, [])
        while log and log[0] <= now - window_ms:
            log.pop(0)
        if len(log) >= limit:
            verdicts[number] = (True, max(1, math.ceil((log[0] + window_ms - now) / 1000)))
        else:
            log.append(now)
            verdicts[number] = (False, 0)
    return verdicts


def some_requests(count=3000):
    rng = random.Random(5)
    start, moment, requests = datetime(2026, 3, 1), 0, []
    for number in range(count):
        moment += rng.choice([0, 0, 1, 7, 150, 4000])
        ip = "hot" if number % 3 else rng.choice(["a", "b", "c"])
        requests.append((ip, start + timedelta(milliseconds=moment), number))
    return requests


REQUESTS = "ip string, ts timestamp_ntz, id long"


@pytest.mark.parametrize("limit, seconds", [(100, 60), (3, 5), (1, 1), (40, 600)])
def test_rate_limit(spark, limit, seconds):
    requests = some_requests()
    df = spark.createDataFrame(requests, REQUESTS).repartition(5)
    result = rates.rate_limit(df, limit, timedelta(seconds=seconds))
    found = {r.id: (r.limited, r.retry_after) for r in result.collect()}
    assert found == limit_one_by_one(requests, limit, seconds * 1000)
    assert any(limited for limited, _ in found.values())


def test_rate_limit_without_address(spark):
    requests = [(None, datetime(2026, 3, 1), n) for n in range(5)]
    result = rates.rate_limit(spark.createDataFrame(requests, REQUESTS), 3, timedelta(seconds=60))
    assert sorted((r.id, r.limited) for r in result.collect()) == [(0, False), (1, False), (2, False), (3, True), (4, True)]


@pytest.mark.parametrize("limit, seconds", [(30, 60), (4, 2)])
def test_a_hot_address_is_split_at_quiet_points(spark, limit, seconds):
    """Four addresses in five share the hot one's key; its bursts are folded apart, the others not at all."""
    rng, start, requests = random.Random(3), datetime(2026, 3, 1), []
    for burst in range(12):
        for _ in range(400):
            moment = burst * 40 * seconds * 1000 + rng.randrange(9 * seconds * 1000)
            requests.append(("hot" if rng.random() < 0.8 else f"a{len(requests)}", start + timedelta(milliseconds=moment), len(requests)))
    df = spark.createDataFrame(requests, REQUESTS).repartition(5)
    found = {r.id: (r.limited, r.retry_after) for r in rates.rate_limit(df, limit, timedelta(seconds=seconds)).collect()}
    assert found == limit_one_by_one(requests, limit, seconds * 1000)
    pieces = rates.crowded_pieces(rates._moments(df, None), limit, seconds * 1000)
    assert {r.ip for r in pieces.select("ip").distinct().collect()} == {"hot"}
    assert pieces.select("piece").distinct().count() >= 12
    folded = rates.decide_moments(df, limit, timedelta(seconds=seconds)).withColumn("task", F.spark_partition_id())
    assert folded.select("task").distinct().count() > 1


@pytest.mark.parametrize("seed", range(6))
def test_rate_limit_around_stretches(spark, seed):
    """Requests crowd around the ends of stretches, where left-over requests decide."""
    rng, requests = random.Random(seed), []
    width = rates.STRETCH * 1000
    for number in range(600):
        moment = rng.randrange(1, 8) * width + rng.choice([-1000, -999, -1, 0, 1, 500, 999, 1000, rng.randrange(-3000, 3000)])
        requests.append((rng.choice("ab"), datetime(2026, 3, 1) + timedelta(milliseconds=moment), number))
    found = rates.rate_limit(spark.createDataFrame(requests, REQUESTS), 5 + seed, timedelta(seconds=1))
    assert {r.id: (r.limited, r.retry_after) for r in found.collect()} == limit_one_by_one(requests, 5 + seed, 1000)


def test_a_carried_log_goes_on_as_if_all_came_at_once(spark):
    requests, limit, window = some_requests(1500), 20, timedelta(seconds=30)
    log, found = None, {}
    for first in range(0, 1500, 300):
        part = spark.createDataFrame(requests[first : first + 300], REQUESTS)
        verdicts = rates.decide_moments(part, limit, window, log)
        found.update({r.id: r.retry_after for r in rates.refused_requests(part, verdicts).collect()})
        kept = rates.accepted_log(part, verdicts, log, window, timedelta(0)).collect()
        newest = max(r.ms for r in kept)
        assert min(r.ms for r in kept) > newest - 30_000  # what is older is released
        log = spark.createDataFrame([tuple(r) for r in kept], "ip string, ms long, accepted long")
    expected = limit_one_by_one(requests, limit, 30_000)
    assert found == {number: wait for number, (limited, wait) in expected.items() if limited}


def run_limiter(spark, tmp_path, portions, limit=20, **options):
    """A micro-batch for each portion; the query is stopped and started again in between."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for requests in portions:
        spark.createDataFrame(requests, REQUESTS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUESTS).parquet(source)
        writer = stream_rates.stream_rate_limit(stream, folder, limit, timedelta(seconds=30), **options)
        writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    return {r.id: (r.limited, r.retry_after) for r in stream_rates.read_verdicts(spark, folder).collect()}


def kept_log(spark, tmp_path, batch_no):
    return stream_rates.read_log(spark, str(tmp_path / "out"), batch_no).collect()


@pytest.mark.parametrize("lateness", [timedelta(0), timedelta(minutes=10)])
def test_streamed_rate_limit(spark, tmp_path, lateness):
    """The log carries over micro-batches; two thirds of all requests are of one address."""
    requests = some_requests(900)
    random.Random(1).shuffle(portion := requests[300:600])
    found = run_limiter(spark, tmp_path, [requests[:300], portion, requests[600:]], lateness=lateness)
    assert found == limit_one_by_one(requests, 20, 30_000)
    assert {r.ip for r in kept_log(spark, tmp_path, 3)}.isdisjoint({"hot", "a", "b", "c"})  # only hashes are stored


def test_a_micro_batch_that_runs_again_changes_nothing(spark, tmp_path):
    requests = some_requests(400)
    found = run_limiter(spark, tmp_path, [requests[:200], requests[200:]])
    log = sorted(kept_log(spark, tmp_path, 2))
    os.remove(tmp_path / "progress" / "commits" / "1")  # it failed before it was recorded
    (crc := tmp_path / "progress" / "commits" / ".1.crc").exists() and os.remove(crc)
    again = run_limiter(spark, tmp_path, [[]])
    assert again == found and sorted(kept_log(spark, tmp_path, 2)) == log


def test_silent_addresses_are_released(spark, tmp_path):
    start = datetime(2026, 3, 1)
    portions = [[(ip, start + timedelta(minutes=5 * n, seconds=s), 10 * n + s) for s in range(4)] for n, ip in enumerate("abc")]
    found = run_limiter(spark, tmp_path, portions, 3, lateness=timedelta(minutes=1))
    assert found == limit_one_by_one(sum(portions, []), 3, 30_000)
    assert {r.accepted for r in kept_log(spark, tmp_path, 3)} == {1} and len(kept_log(spark, tmp_path, 3)) == 3


def test_verdicts_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    # Around the hour that New York skips.
    times = [datetime(2026, 3, 8, 1, 59, 59) + timedelta(seconds=s) for s in (0, 0, 1, 30, 61, 3_600)]
    rows = [("a", at, number) for number, at in enumerate(times)]
    found = []
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            requests = spark.createDataFrame(rows, "ip string, ts timestamp_ntz, id long")
            found.append(sorted((r.id, r.limited, r.retry_after) for r in rates.rate_limit(requests, 2).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == found[1]
    assert [limited for _, limited, _ in found[0]] == [False, False, True, True, False, False]


def test_a_trust_table_agrees_with_the_list(spark):
    entries = ["10.0.0.0/8", "192.168.1.7", " 203.0.113.128/25 ", "2001:db8::/33", "fe80/10", "1.2.3.4/0x", "5.6.7.8/33", "::1", "", "9.9.9.9/32", "300.1.1.1/8"]
    addresses = ["10.200.3.4", "11.0.0.1", "192.168.1.7", "192.168.1.7:80", "203.0.113.127", "203.0.113.128", "[2001:db8::1]:443", "2001:db8:8000::1",
                 "fe80::1", "::ffff:10.1.1.1", "1.2.3.4", "5.6.7.8", "0:0:0:0:0:0:0:1", "::1", "9.9.9.9", "", None, "nonsense", "10.200.3.4"]
    rows = spark.createDataFrame(list(enumerate(addresses)), "id int, ip string")
    networks = spark.createDataFrame([(e,) for e in entries], "entry string")
    found = {r.id: r.listed for r in clients.mark_listed(rows, networks).collect()}
    expected = {r.id: r.listed for r in rows.select("id", ip_in_cidr(F.col("ip"), entries).alias("listed")).collect()}
    assert found == expected and len(found) == len(addresses)
    assert not any(r.listed for r in clients.mark_listed(rows, networks.limit(0)).collect())


def test_late_requests_get_a_verdict(spark, tmp_path):
    """Each is judged at its own time, by the accepted requests of the window before it."""
    portions = [[("a", datetime(2026, 3, day, 12, 0, second), 100 * day + second) for second in seconds] for day, seconds in ((20, (1, 2, 3)), (10, (1, 2)), (20, (0, 4)))]
    found = run_limiter(spark, tmp_path, portions, 3)
    assert {number: limited for number, (limited, _) in found.items()} == {
        2001: False, 2002: False, 2003: False, 1001: False, 1002: False, 2000: False, 2004: True,
    }
