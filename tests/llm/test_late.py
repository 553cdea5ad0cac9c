import collections
import random
import zlib

import pandas as pd
import pytest

from alertloom.llm.late_sessions import session_versions
from alertloom.llm.queries import QUERIES


def expected(events, gap=420):
    """Batch by batch: all sessions of the events so far, those with a new one are versions."""
    out, users = [], collections.defaultdict(list)
    for user, *e in events:
        users[user].append(e)
    for user, own in users.items():
        standing = []
        for b in sorted({x[1] for x in own}):
            runs = []
            for x in sorted(x for x in own if x[1] <= b):
                if runs and x[0] - runs[-1][-1][0] <= gap:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            for r in runs:
                new = sum(x[1] == b for x in r)
                if not new:
                    continue
                s, z = r[0][0], r[-1][0]
                old = [o for o in standing if s <= o[1] and o[2] <= z]
                for o in old:
                    out[o[0]][8:] = [b, s]
                    standing.remove(o)
                standing.append((len(out), s, z))
                out.append([user, b, s, z, len(r), new, len(old), sum(x[2] for x in r), -1, -1])
    return sorted(map(tuple, out))


def got(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


def table(spark, events):
    return spark.createDataFrame(events, "user long, time long, batch long, h long").repartition(5)


def test_query_is_exact(spark, small):
    events = []
    for c_id, turn in pd.read_parquet(f"{small}/conversations.parquet")[["conv_id", "turn"]].itertuples(index=False):
        c, h = zlib.crc32(str(c_id).encode()), zlib.crc32(f"{c_id}:{turn}".encode())
        s, g = (c // 2) % 7200 + 300 * turn + h % 600, h // 600
        events.append((2 * (c_id // 8) + c % 2, s, s // 3600 + (g % 4 if g % 3 == 0 else 0), h))
    assert got(QUERIES["op13_late_sessions"](spark, small)) == expected(events)


@pytest.mark.parametrize("piece_s", [421, 1000])
def test_sessions_over_many_pieces(spark, piece_s):
    """Long and short sessions, times below zero, ties, repeated rows, and batches that have nothing to do with time."""
    rnd, events = random.Random(piece_s), []
    for user in range(30):
        span, late = rnd.choice([500, 3000, 20_000]), rnd.choice([1, 3, 10, 40])
        for _ in range(rnd.choice([1, 5, 30, 150])):
            events.append((user, rnd.randrange(span) - span // 3, rnd.randrange(late), rnd.randrange(1000)))
    events += events[:40]
    assert got(session_versions(table(spark, events), piece_s=piece_s)) == expected(events)


def test_one_session_with_late_rows_at_both_ends(spark):
    """A user's only session runs over 90 pieces; rows far back and ahead come years later."""
    events = [(1, 300 * k, 300 * k // 3600, k) for k in range(600)]
    events += [(1, 7, 5_000_000, 1), (1, 300 * 599 + 5, 20_000_000, 2), (1, 90_010, 3, 4)]
    assert got(session_versions(table(spark, events), piece_s=2000)) == expected(events)


def test_nulls_and_empty(spark):
    rows = [(1, 0, 0, 5), (None, 1, 0, 1), (1, None, 0, 1), (1, 2, None, 1), (1, 400, 0, None), (1, 400, 0, None)]
    assert got(session_versions(table(spark, rows))) == [(1, 0, 0, 400, 3, 3, 0, 5, -1, -1)]
    assert session_versions(table(spark, [])).count() == 0
    clash = table(spark, rows).selectExpr("*", "h as H", "time as Time")
    assert session_versions(clash).count() == 1
    with pytest.raises(ValueError):
        session_versions(table(spark, rows), gap=420, piece_s=420)
