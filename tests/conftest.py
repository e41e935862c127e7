import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SAMPLES = {
    "combined": '198.18.4.77 - mia [03/Mar/2024:21:40:07 +0100] "DELETE /cart/18 HTTP/2" 409 512 "https://shop.test/" "Probe 1"',
    "common": '203.0.113.200 ident - [28/Feb/2023:00:00:01 +0000] "HEAD /status HTTP/1.0" 204 -',
    "fixed8": "2025-11-02 17:06:45 DEBUG 172.20.1.9 PATCH /profile/7 202 38ms",
    "json": '{"time":"2025-04-09T08:15:00","severity":"error","remote_addr":"198.51.100.61",'
            '"uri":"POST /orders","code":502,"latency_ms":1203,"size":40}',
    "generic": "Sep 14 11:22:33 NOTICE upstream 192.168.7.8 gave GET /feed status=504 after 95 ms",
}


@pytest.fixture
def samples():
    return dict(SAMPLES)
