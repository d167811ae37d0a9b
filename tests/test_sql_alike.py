"""Cases in which Java and the SQL twins' engine read the same pattern or number differently."""

import random

import duckdb
import pytest

from tracewright.functions import text as tx
from tracewright.operators import reports
from tracewright.plans import reports as plans


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_lexical_baseline_beside_other_scripts(spark, role):
    """a word beside a letter that is not ASCII is a word to SQL, and two letters fold to s and k."""
    words = ("no", "stop", "instead", "actually", "remember", "found", "because", "ſtop", "inſtead", "ſpot", "aſk", "İnstead", "noſ", "Noel", "always_", "turnſ out")
    texts = [f"{a}{w}{b}" for w in words for a in ("", "Ñ", "é", "x", "_", " ") for b in ("", "ë", "ß", "1", ".", "́")] + [None, ""]
    got = reports.lexical_baseline(spark.createDataFrame([(role, t) for t in texts], "role string, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?)", [(role, t) for t in texts])
    want = con.execute(plans.ORACLE_SQL["lexical_baseline"]).fetchall()
    assert [(role, len(texts), *(sum(r[n] for r in got.collect()) for n in reports.LEXICAL))] == want


def test_amount_rounds_the_number_itself(spark):
    """half cents are rounded as printf does."""
    random.seed(3)
    costs = [0.285, 0.125, 0.375, 1.005, 1234567.125, 0.0, 0.004999, 12345678.9] + [random.randrange(10**7) / 1000 for _ in range(500)] + [(2 * random.randrange(10**5) + 1) / 200 for _ in range(500)]
    frame = spark.createDataFrame([(c, "exact") for c in costs], "cost double, status string")
    got = [r[0] for r in frame.select(tx.amount(frame.cost, frame.status)).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT printf('$%.2f', ?::DOUBLE)", [c]).fetchone()[0] for c in costs]
