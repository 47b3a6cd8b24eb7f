import datetime as dt
import random
import time

import pytest

from callweave.streaming.ledger import FileLedger
from callweave.streaming.scan import LISTING, scan_listings, stream_scan, watch_folder

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def listings(seed=1, n=6):
    rng = random.Random(seed)
    return [[(f"/r/{rng.randrange(12)}.wav", rng.choice([None, 10, 20]), at(rng.randrange(3))) for _ in range(rng.randrange(9))] for _ in range(n)]


def slow(batches):
    """What a plain loop over the batches finds: (path, length, time, action, batch), and the last state."""
    state, out = {}, []
    for no, rows in enumerate(batches):
        latest = {}
        for p, n, t in rows:
            latest[p] = max(latest.get(p, (t, -1 if n is None else n)), (t, -1 if n is None else n))
        for p, (t, n) in latest.items():
            now = (None if n < 0 else n, t)
            if state.get(p) != now:
                out.append((p, *now, "updated" if p in state else "added", no))
                state[p] = now
    return sorted(out, key=repr), {p: s for p, s in state.items()}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("every", [1, 2, 50])
def test_replayed_batches_add_nothing(spark, tmp_path, every):
    batches = listings()
    ledger = FileLedger(spark, str(tmp_path / "l"), compact_every=every)
    for no, rows in enumerate(batches):
        for again in (no, no, max(0, no - 2)):  # each twice, and an older one
            ledger(spark.createDataFrame(batches[again], LISTING).repartition(3), again)
    changes, state = slow(batches)
    assert rows_of(ledger.changes()) == changes and ledger.batches() == list(range(len(batches)))
    assert {r.path: (r.length, r.modificationTime) for r in FileLedger(spark, str(tmp_path / "l")).state().collect()} == state


def test_a_batch_that_broke_off_comes_again_whole(spark, tmp_path):
    got, fail = {}, [True]

    def then(changes, batch):
        got[batch] = changes.count()
        if fail and batch == 1:
            fail.clear()
            raise RuntimeError("lost")

    ledger = FileLedger(spark, str(tmp_path / "l"), then=then)
    one, two = ([("/a", 1, at(0)), ("/b", 1, at(0))], [("/a", 2, at(5)), ("/c", 3, at(5))])
    ledger(spark.createDataFrame(one, LISTING), 0)
    with pytest.raises(RuntimeError):
        ledger(spark.createDataFrame(two, LISTING), 1)
    assert ledger.batches() == [0] and ledger.state().count() == 2  # what isn't entered isn't seen
    ledger(spark.createDataFrame(two, LISTING), 1)
    assert got == {0: 2, 1: 2} and rows_of(ledger.changes()) == slow([one, two])[0]


def test_no_listing_and_no_change(spark, tmp_path):
    ledger = FileLedger(spark, str(tmp_path / "l"))
    assert ledger.batches() == [] and ledger.state().count() == 0 and ledger.changes().count() == 0
    ledger(spark.createDataFrame([], LISTING), 0)
    ledger(spark.createDataFrame([("/a", 1, at(0)), (None, 1, at(0))], LISTING), 1)
    ledger(spark.createDataFrame([("/a", 1, at(0))], LISTING), 2)
    assert ledger.batches() == [0, 1, 2] and ledger.changes().count() == 1


def test_streamed_listings_survive_a_lost_checkpoint(spark, tmp_path):
    batches = [b for b in listings(3, 4) if b]
    ledger = FileLedger(spark, str(tmp_path / "l"))
    for rows in batches:
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        scan_listings(spark, str(tmp_path / "in"), str(tmp_path / "ck"), ledger).awaitTermination(120)
    assert rows_of(ledger.changes()) == slow(batches)[0]
    # another checkpoint begins again at batch 0, with everything in it
    scan_listings(spark, str(tmp_path / "in"), str(tmp_path / "ck2"), ledger).awaitTermination(120)
    assert rows_of(ledger.changes()) == slow(batches)[0]


def test_a_file_recorded_again_comes_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(b"1")
    ledger = FileLedger(spark, str(tmp_path / "l"))
    q = watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "ck"), ledger, every="1 second")

    def wait(n):
        end = time.time() + 90
        while time.time() < end and ledger.changes().count() < n:
            time.sleep(0.5)
        return sorted((r.path.rsplit("/")[-1], r.length, r.action) for r in ledger.changes().collect())

    try:
        assert wait(1) == [("a.wav", 1, "added")]
        (tmp_path / "in" / "a.wav").write_bytes(b"123")
        (tmp_path / "in" / "b.wav").write_bytes(b"1")
        assert wait(3) == [("a.wav", 1, "added"), ("a.wav", 3, "updated"), ("b.wav", 1, "added")]
    finally:
        q.stop()
    once = FileLedger(spark, str(tmp_path / "l2"))
    stream_scan(spark, str(tmp_path / "in"), str(tmp_path / "ck3"), once).awaitTermination(120)
    assert once.changes().count() == 2
