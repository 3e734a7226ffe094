"""Correlations, echo and resampling against plain loops."""

import math
import random

import numpy as np

from parley.operators import signal


def lags(a, b, most):
    """Pairs and correlation of each lag, by loops."""
    out = {}
    for lag in range(-most, most + 1):
        pairs = [(v, w) for at, v in a for at2, w in b if at2 == at + lag]
        if not pairs:
            continue
        x, y = np.array(pairs).T
        flat = len(pairs) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0
        out[lag] = (len(pairs), 0.0 if flat else round(float(np.corrcoef(x, y)[0, 1]), 6))
    return out


def test_lag_correlation_over_blocks_equals_all_pairs(spark):
    rng = random.Random(6)
    keys = {}
    for k in ("long", "short", "gaps", None):
        n = {"long": 900, "short": 3, "gaps": 200, None: 50}[k]
        a = [(i, rng.gauss(1000, 3)) for i in range(-n // 2, n // 2) if k != "gaps" or rng.random() < 0.4]
        b = [(at + 7, v + rng.gauss(0, 0.1)) for at, v in a if rng.random() < 0.9] + [(a[0][0], 5.0)] * (k == "gaps")
        keys[k] = (a, b)
    flat = ([(i, 2.0) for i in range(20)], [(i, float(i % 3)) for i in range(20)])
    keys["flat"] = flat
    frame = lambda side: spark.createDataFrame([(k, at, v) for k, pair in keys.items() for at, v in pair[side]], "k string, at long, v double")
    found = signal.lag_correlation(frame(0), frame(1), ["k"], 12, block=64)
    got = {}
    for r in found.collect():
        got.setdefault(r.k, {})[r.lag] = (r.pairs, round(r.corr, 6))
        if r.best:
            assert r.k in ("long", "gaps", "short") and (r.k == "short" or r.lag == 7)
    for k, (a, b) in keys.items():
        if k is not None:  # a null key meets nothing
            wanted = lags(a, b, 12)
            assert set(got[k]) == set(wanted)
            for lag, (pairs, corr) in wanted.items():
                assert got[k][lag][0] == pairs and math.isclose(got[k][lag][1], corr, abs_tol=2e-5), (k, lag)


def test_lag_correlation_of_wide_lags_has_small_groups(spark):
    n = 30_000
    rng = np.random.default_rng(1)
    v = rng.normal(size=n)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "at long, v double")
    b = spark.createDataFrame([(i + 531, float(x)) for i, x in enumerate(v)], "at long, v double")
    best = signal.lag_correlation(a, b, [], 1000, block=4096).where("best").collect()
    assert [(r.lag, r.pairs, round(r["corr"], 9)) for r in best] == [(531, n, 1.0)]


def speech(n, seed, rate=16_000):
    """Noise under an envelope of syllables."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / rate
    return np.trunc(rng.uniform(-1, 1, n) * (0.4 + 0.6 * np.abs(np.sin(2 * np.pi * 2.5 * t))) * 6000)


def in_rows(name, mic, system, size):
    return [(name, a, [float(x) for x in mic[a : a + size]], [float(x) for x in system[a : a + size]]) for a in range(0, len(mic), size)]


FRAMES = "session string, start long, mic array<double>, system array<double>"


def echo_by_loops(mic, system, r):
    """Delay, correlation and windows, sample by sample."""
    window, most, probe, guard = r.frames(r.window_ms), r.frames(r.max_delay_ms), r.frames(r.probe_ms), r.frames(r.guard_ms)
    starts = sorted(range(0, len(system) - probe + 1, max(1, probe // 4)), key=lambda s: (-math.sqrt(sum(x * x for x in system[s : s + probe]) / probe), s))
    chosen = []
    for s in starts:
        if len(chosen) < r.probes and all(abs(s - c) >= probe for c in chosen):
            chosen.append(s)
    best = None
    for s in chosen:
        end = min(s + probe + most, len(mic))
        if end <= s + most:
            continue
        for lag in range(most + 1):
            n = min(end - s - lag, probe)
            a, b = mic[s + lag : s + lag + n], system[s : s + n]
            norm = math.sqrt(float(a @ a) * float(b @ b))
            value = round(float(a @ b) / norm, 9) if norm > 1e-9 else 0.0
            if best is None or value > best[1]:
                best = (lag, value)
    if best is None or best[1] < r.least_correlation:
        return best, []
    delay, weights, left, ref = max(0, best[0] - guard), np.zeros(r.taps), mic.copy(), np.zeros(len(mic))
    for i in range(len(mic)):
        end = i - delay + 1
        ref[i] = system[end - 1] if 0 < end <= len(system) else 0
        if r.taps <= end <= len(system):
            x = system[end - r.taps : end]
            left[i] -= weights @ x
            if x @ x > 0:
                weights += r.pace * left[i] / (x @ x + 1.0) * x
    out = []
    for k in range(len(mic) // window):
        part = slice(k * window, (k + 1) * window)
        m, e, s = ((v[part] ** 2).sum() for v in (mic, left, ref))
        share = min(1.0, max(0.0, 1 - e / m)) if m > 0 else 0.0
        levels = math.sqrt(m / window), math.sqrt(s / window)
        out.append((k, round(share, 6), round(levels[0], 6), round(levels[1], 6), min(levels) >= r.least_rms and share >= r.explained))
    return best, out


def test_echo_equals_loops_whatever_the_rows(spark):
    from parley.operators import audio

    r = audio.EchoRules(rate=1000, window_ms=60, max_delay_ms=50, probe_ms=400, guard_ms=3, taps=32)
    system = speech(3000, 1, 1000)
    tracks = {"echo": np.concatenate((np.zeros(23), 0.5 * system[:-23])) + 0.05 * speech(3000, 2, 1000), "speech": speech(3000, 3, 1000), "short": system[:300] / 2}
    tracks["talk"] = tracks["echo"] + np.where(np.arange(3000) // 600 % 2, speech(3000, 4, 1000), 0)
    rows = []
    for name, size in (("echo", 170), ("speech", 1000), ("short", 100), ("talk", 1)):
        rows += in_rows(name, tracks[name], system[: len(tracks[name])], size)
    random.Random(1).shuffle(rows)
    got = {}
    for w in audio.echo_windows(spark.createDataFrame(rows, FRAMES), ["session"], r).collect():
        got.setdefault(w.session, []).append((w.window, round(w.explained, 6), round(w.mic_rms, 6), round(w.system_rms, 6), w.echo))
    for name, mic in tracks.items():
        best, wanted = echo_by_loops(mic, system[: len(mic)], r)
        assert sorted(got.get(name, [])) == wanted, name
    assert "speech" not in got and "short" not in got
    assert sum(w[4] for w in got["echo"]) >= 45 and sum(w[4] for w in got["talk"]) < 40


def test_echo_at_full_size(spark):
    from parley.operators import audio

    n = 16_000 * 6
    system = speech(n, 5)
    echo = np.trunc(np.concatenate((np.zeros(1200), 0.4 * system[:-1200])) + np.concatenate((np.zeros(1500), 0.2 * system[:-1500])))
    frames = spark.createDataFrame(in_rows("a", echo, system, 1600) + in_rows("b", speech(n, 6), system, 1600), FRAMES)
    delays = {d.session: d for d in audio.echo_delays(frames, ["session"], audio.EchoRules()).collect()}
    assert delays["a"].delay == 1200 and delays["a"].correlation > 0.8 and delays["b"].correlation < 0.3
    got = audio.echo_windows(frames, ["session"]).collect()
    assert {w.session for w in got} == {"a"} and len(got) == 20 and sum(w.echo for w in got) >= 18
    assert {(w.end_ms - w.start_ms, w.delay_ms) for w in got} == {(300, 75)}


def test_resampled_chunks_equal_the_whole_track(spark):
    from parley.operators import audio

    rng = np.random.default_rng(7)
    rows, wanted = [], {}
    for name, n, sizes in (("long", 1003, (97,)), ("tiny", 40, (1,)), ("mixed", 300, (5, 90, 1)), ("none", 0, (1,))):
        left, right = rng.normal(size=n), rng.normal(size=n)
        a, seq = 0, 0
        while a < n or (n == 0 and seq == 0):
            size = sizes[seq % len(sizes)]
            rows.append((name, seq, [float(x) for pair in zip(left[a : a + size], right[a : a + size], strict=True) for x in pair]))
            a, seq = a + size, seq + 1
        wanted[name] = (left + right) / 2
    chunks = spark.createDataFrame(rows, "session string, seq long, samples array<double>")
    for rate, to in ((48, 16), (3, 2), (2, 3), (44_100, 16_000)):
        up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
        reach = 6 * max(1, -(-down // up))
        made = audio.resampled(chunks, ["session"], rate, to, 2, 6).collect()
        for name, track in wanted.items():
            mine = sorted((m for m in made if m.session == name), key=lambda m: m.seq)
            out = np.concatenate([np.array(m.pcm, float) for m in mine])
            at = np.arange(-(-len(track) * up // down)) * down / up
            full = np.array([(track * audio.kernel(np.arange(len(track)) - t, up, down, reach)).sum() for t in at])
            assert len(out) == len(full) and np.allclose(out, full, atol=1e-9), (name, rate)
            assert [m.first for m in mine] == [sum(len(x.pcm) for x in mine[:i]) for i in range(len(mine))]


def islands(chunks):
    """Pieces of one session's chunks (ts, duration, rate, seq), by a loop."""
    out, before, island = [], None, -1
    for ts, ms, rate, seq in sorted(chunks, key=lambda c: (c[0], c[3], c[1], c[2])):
        if before is None or before[0] + before[1] != ts or before[2] != rate:
            island, start = island + 1, ts
        piece = (ts - start) // 2000
        if out and out[-1][:2] == [island, piece]:
            out[-1][3] += ms
            out[-1][5] += 1
        else:
            out.append([island, piece, ts, ms, rate, 1])
        before = ts, ms, rate
    return [tuple(row) for row in out]


def test_chunk_islands_against_a_loop_with_one_sort_and_no_table_of_pieces(spark):
    rng = random.Random(8)
    keys = {}
    for k in ("a", "b", None):
        ts = 0
        for seq in range(200):
            ms, rate = rng.choice((300, 500, 2500)), 16000 if rng.random() < 0.95 else 8000
            keys.setdefault(k, []).append((ts, ms, rate, seq))
            ts += ms + 10 * (rng.random() < 0.05)
    keys["c"] = [(0, 500, 16000, 1)]
    rows = [(k, *c) for k, chunks in keys.items() for c in chunks]
    schema = "session string, ts_ms int, duration_ms int, rate int, seq int"
    df = spark.createDataFrame(rows + rows[::3] + rows[::7], schema)
    found = signal.chunk_islands(signal.listed_once(df, ["session"]), ["session"])
    wanted = {(k, *piece) for k, chunks in keys.items() for piece in islands(chunks)}
    assert found.count() == len(wanted) and {tuple(r) for r in found.collect()} == wanted
    assert any(piece[2] > 0 for piece in wanted) and any(piece[6] > 1 for piece in wanted)
    plan = signal.chunk_islands(signal.listed_once(df, ["session"]), ["session"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan
    assert signal.listed_once(spark.createDataFrame([("a", None, None, None, None)] * 2, schema), ["session"]).count() == 1
