import os
import sys
from datetime import timedelta
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from core_cases import START  # noqa: E402
from tickloom import schemas  # noqa: E402
from tickloom.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.maxMetadataStringLength": "2000",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make_ticks(spark):
    """Ticks from (seq, milliseconds after START, symbol, price text, volume)."""

    def build(rows):
        return spark.createDataFrame(
            [(seq, START + timedelta(milliseconds=ms), symbol, Decimal(price), volume)
             for seq, ms, symbol, price, volume in rows],
            schemas.TICKS,
        )

    return build


@pytest.fixture
def feed(make_ticks):
    """400 ticks of three symbols over 20 s across midnight, with ties and zero volumes."""
    rows = []
    for seq in range(400):
        symbol = ("AAPL", "AAPL", "MSFT", "TSLA", "AAPL")[seq * 7 % 5]
        cents = 10_000 + (seq * 7919) % 5_000
        rows.append((seq, (seq // 3) * 150, symbol, f"{cents / 100:.2f}", (seq * 13) % 11))
    return make_ticks(rows)
