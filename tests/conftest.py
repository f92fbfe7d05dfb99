"""Shared session and frames."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodgewise.session import local_session  # noqa: E402

# name, type, and how row i of a made-up ledger fills it; the strides share no factor with the cycles
LEDGER = {
    "booking_id": ("bigint", lambda i: 7000 + i),
    "platform": ("string", lambda i: ("App", "Desk", "Partner")[i * 5 % 11 % 3]),
    "branch": ("string", lambda i: ("Harbour", "Old Town", "Ridge")[i * 7 % 17 % 3]),
    "room": ("string", lambda i: ("Twin", "Loft", "Cabin", "Studio")[i * 3 % 13 % 4]),
    "country": ("string", lambda i: ("Chile", "Norway", "Kenya", "Japan")[i * 11 % 19 % 4]),
    "num_adults": ("int", lambda i: 1 + i * 13 % 23 % 4),
    "num_children": ("int", lambda i: i * 17 % 29 % 4),
    "first_time": ("int", lambda i: i * 19 % 31 % 2),
    "booking_month": ("int", lambda i: 1 + i * 23 % 37 % 12),
    "arrival_month": ("int", lambda i: 1 + i * 29 % 41 % 12),
    "arrival_day": ("int", lambda i: 1 + i * 31 % 43 % 28),
    "checkout_month": ("int", lambda i: 1 + i * 37 % 47 % 12),
    "checkout_day": ("int", lambda i: 1 + i * 41 % 53 % 28),
    "price": ("double", lambda i: 60.0 + i * 383 % 641 * 1.25),
    "no_show": ("int", lambda i: int(i * 383 % 641 > 400) ^ int(i % 9 == 0)),
}
CLEAN_SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in LEDGER.items())


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def clean_rows(n: int) -> list[tuple]:
    return [tuple(fill(i) for _, fill in LEDGER.values()) for i in range(n)]


@pytest.fixture(scope="session")
def clean_bookings(spark):
    """640 bookings with typed columns and a target that depends on the price, but for one row in nine."""
    return spark.createDataFrame(clean_rows(640), CLEAN_SCHEMA).repartition(4).persist()
