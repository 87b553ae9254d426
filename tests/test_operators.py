"""Scenarios with known answers, and cases that the derived table doesn't have."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallygrid.config import COURT
from rallygrid.operators import actions, homography, stats, teams, tracking, tracks
from rallygrid.plans import match, queries
from rallygrid.sources import correspondences, detections

POSITIONS = "clip_id long, tracker_id long, frame_idx long, det_ord long, x_m double, y_m double, interpole boolean"


def positions(spark, *tracks_):
    rows = [(1, t, f, f * 10 + t, float(x), float(y), i) for t, points in tracks_ for f, x, y, i in points]
    return spark.createDataFrame(rows, POSITIONS)


def run(points, t=1):
    return t, [(f, x, y, False) for f, x, y in points]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_straight_run(spark):
    r = one(stats.player_stats(positions(spark, run([(i, 0.4 * i, 10) for i in range(26)])), 25))
    assert r.distance_parcourue_m == pytest.approx(10) and r.nb_frames_detectees == 26 and r.vitesse_moyenne_m_s == pytest.approx(10)
    assert (r.x_min, r.x_max) == (0, pytest.approx(10))


def test_interpolated_rows_count_only_if_asked(spark):
    p = positions(spark, (1, [(0, 0, 0, False), (1, 1, 0, False), (2, 10, 0, True), (3, 2, 0, False)]))
    assert one(stats.player_stats(p, 25)).distance_parcourue_m == pytest.approx(2)
    assert one(stats.player_stats(p, 25, real_only=False)).distance_parcourue_m == pytest.approx(18)


def test_speed_cap(spark):
    p = positions(spark, run([(0, 0, 0), (1, 0.5, 0), (2, 20, 0), (3, 20.4, 0)]))
    assert one(stats.player_stats(p, 25)).vitesse_max_m_s == pytest.approx(10)
    far = positions(spark, run([(0, 0, 0), (1, 100, 0)]))
    assert one(stats.player_stats(far, 25)).vitesse_max_m_s == 12  # all above the cap
    assert one(stats.player_stats(far, 25, max_speed=None)).vitesse_max_m_s > 1000


def test_only_interpolated_rows_give_zeros(spark):
    r = one(stats.player_stats(positions(spark, (1, [(0, 3, 4, True), (1, 4, 4, True)])), 25))
    assert r.nb_frames_detectees == 0 and r.distance_parcourue_m == r.vitesse_max_m_s == r.centroide_x == 0


def test_rows_of_one_frame_are_a_frame_apart(spark):
    r = one(stats.player_stats(spark.createDataFrame([(1, 1, 0, 0, 0.0, 0.0, False), (1, 1, 0, 1, 0.2, 0.0, False)], POSITIONS), 25))
    assert r.vitesse_max_m_s == pytest.approx(5) and r.vitesse_moyenne_m_s == 0


def test_empty_and_invalid_stats(spark):
    none = positions(spark)
    assert stats.player_stats(none, 25).count() == 0 and len(stats.player_stats(none, 25).columns) == 13
    with pytest.raises(ValueError):
        stats.player_stats(none, 0)


def test_heatmap(spark):
    cells = stats.heatmap(positions(spark, run([(0, 20, 10)])), 1.0, None).collect()
    assert [(c.iy, c.ix, c.densite) for c in cells] == [(10, 20, 1.0)]
    smooth = stats.heatmap(positions(spark, run([(0, 39.9, -3), (1, 20, 10)])), 1.0, 1.0)
    assert smooth.agg(F.sum("densite")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        stats.heatmap(positions(spark), 0)


def test_block_width(spark):
    p = positions(spark, *(run([(0, 10 + t, y)], t) for t, y in ((2, 5), (4, 8), (6, 11), (8, 14), (1, 1))))
    team = spark.createDataFrame([(1, t, t % 2) for t in (1, 2, 4, 6, 8)], "clip_id long, tracker_id long, team int")
    r = one(stats.block_width(p, team, 0, 25))
    assert (r.largeur_y_m, r.nb_defenseurs_visibles, r.x_moyen) == (9, 4, 15)


def test_gaps(spark):
    filled = tracks.interpolate(positions(spark, run([(0, 0, 0), (4, 4, 8)]))).where("interpole").orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.x_m, r.y_m) for r in filled] == [(1, 1, 2), (2, 2, 4), (3, 3, 6)]
    for points in ([(0, 0, 0), (100, 1, 1)], [(5, 0, 0)], [(0, 0, 0), (1, 1, 1)]):
        assert not tracks.interpolate(positions(spark, run(points))).where("interpole").count()


def test_short_tracks(spark):
    p = positions(spark, run([(i, 1, 1) for i in range(20)]), run([(0, 1, 1), (1, 1, 1)], 2), (3, [(0, 1, 1, False), (1, 1, 1, True), (2, 1, 1, True)]))
    assert {r.tracker_id for r in tracks.drop_short_tracks(p, 5).collect()} == {1}
    assert tracks.drop_short_tracks(p, 1).count() == p.count()


def resumes(spark, *runs):
    return {(r.a, r.b) for r in tracks.resume_pairs(tracks.resume_candidates(tracks.track_bounds(positions(spark, *runs)))).collect()}


def test_resumed_identities(spark):
    a = run([(0, 18, 10), (10, 20, 10)])
    assert resumes(spark, a, run([(14, 20.5, 10), (20, 22, 10)], 2)) == {(1, 2)}
    assert resumes(spark, a, run([(14, 36, 10)], 2)) == set() == resumes(spark, a, run([(100, 20, 10)], 2))
    b, c = run([(12, 20, 10), (20, 21, 10)], 2), run([(24, 21, 10), (30, 22, 10)], 3)
    assert resumes(spark, a, b, c) == {(1, 2), (2, 3)}
    # two ends compete for one start: the earlier end takes the nearest, the later one what is left
    rivals = run([(0, 10, 10), (8, 10, 10)], 1), run([(0, 10, 10), (9, 10, 10)], 2)
    assert resumes(spark, *rivals, run([(12, 10, 10)], 3), run([(12, 11, 10)], 4)) == {(1, 3), (2, 4)}


def test_resumes_match_a_plain_greedy(spark):
    rng = random.Random(5)
    for _ in range(4):
        runs = []
        for t in range(40):
            f, x, y = rng.randrange(200), rng.uniform(0, 10), rng.uniform(3, 10)
            runs.append(run([(f, x, y), (f + rng.randrange(1, 20), x + rng.uniform(-1, 1), y)], t))
        got = resumes(spark, *runs)
        order = {t: k for k, (t, p) in enumerate(sorted(runs, key=lambda r: (r[1][0][0], r[1][0][0] * 10 + r[0])))}
        want, taken = set(), set()
        for t, p in sorted(runs, key=lambda r: (r[1][1][0], order[r[0]])):
            end, best = p[1], None
            for u, q in sorted(runs, key=lambda r: order[r[0]]):
                gap, d = q[0][0] - end[0], ((q[0][1] - end[1]) ** 2 + (q[0][2] - end[2]) ** 2) ** 0.5
                if u != t and u not in taken and 0 < gap <= 30 and d <= 3 and (best is None or d < best[0]):
                    best = (d, u)
            if best:
                taken.add(best[1])
                want.add((t, best[1]))
        assert got == want


def test_vote_ties_go_to_the_first(spark):
    rows = [(1, 7, 0, 1, 2), (1, 7, 1, 2, 0), (1, 7, 2, 3, 0), (1, 7, 3, 4, 2)]
    det = spark.createDataFrame(rows, "clip_id long, tracker_id long, frame_idx long, det_ord long, class_id int")
    assert one(tracks.majority(det, "class_id")).class_id == 2


def found(spark, profile, fps=25, **options):
    rows = [(1, f, n) for f, n in profile]
    return [(r.frame_debut, r.frame_fin) for r in actions.detect_actions(spark.createDataFrame(rows, "clip_id long, frame_idx long, nb int"), fps, **options).orderBy("frame_debut").collect()]


def level(*spans):
    return [(f, n) for n, lo, hi in spans for f in range(lo, hi)]


def test_actions(spark):
    assert found(spark, level((0, 0, 50), (7, 50, 150), (0, 150, 250))) == [(50, 149)]
    assert found(spark, level((0, 0, 20), (7, 20, 40), (0, 40, 150))) == []
    assert found(spark, level((0, 0, 25), (7, 25, 100), (2, 100, 120), (7, 120, 200), (0, 200, 250))) == [(25, 199)]
    assert found(spark, level((0, 0, 20), (7, 20, 120), (0, 120, 240), (7, 240, 360))) == [(20, 119), (240, 359)]
    assert found(spark, level((7, 25, 200))) == [(25, 199)]
    assert found(spark, level((7, 0, 100), (7, 400, 500))) == [(0, 499)]  # a hole without low frames closes nothing
    with pytest.raises(ValueError):
        found(spark, [(0, 1)], start=4, end=6)


def test_actions_match_a_state_machine(spark):
    rng = random.Random(9)
    for _ in range(6):
        profile, n = [], 5
        for f in range(0, 600, 2):
            n = max(0, min(10, n + rng.choice([-2, -1, 0, 1, 2])))
            if rng.random() < 0.9:
                profile.append((f, n))
        want, start, last = [], None, None
        for f, n in profile:
            if start is None:
                if n >= 6:
                    start = last = f
            elif n >= 4:
                last = f
            elif (f - last) / 25 > 1.0:
                want.append((start, last))
                start = None
        if start is not None:
            want.append((start, last))
        assert found(spark, profile, min_s=1.0, pause_s=1.0) == [(a, b) for a, b in want if (b - a) / 25 >= 1.0]


def test_frames_without_detections_have_no_players(spark):
    frames = spark.createDataFrame([(1, f) for f in (0, 2, 4, 6)], "clip_id long, frame_idx long")
    det = spark.createDataFrame([(1, 0, 7), (1, 0, 8), (1, 4, 7), (1, 6, 9)], "clip_id long, frame_idx long, tracker_id long")
    classes = spark.createDataFrame([(1, 7, 0), (1, 8, 0), (1, 9, 2)], "clip_id long, tracker_id long, class_id int")
    assert {tuple(r) for r in actions.players_per_frame(frames, det, classes).collect()} == {(1, 0, 2), (1, 2, 0), (1, 4, 1), (1, 6, 0)}
    assert {r.nb for r in actions.players_per_frame(frames, det.limit(0), classes).collect()} == {0}


def test_count_queries_count_every_detection(spark):
    sf_dir, (start, end, least, pause) = "/root/testdata/sf0.01", queries.ACTIONS
    det = detections.detections_from_events(spark, sf_dir)
    players = {(r.clip_id, r.tracker_id) for r in tracks.majority(det, "class_id").collect() if r.class_id == 0}
    counts = {}
    for r in det.collect():
        counts.setdefault(r.clip_id, {}).setdefault(r.frame_idx, 0)
        counts[r.clip_id][r.frame_idx] += (r.clip_id, r.tracker_id) in players
    get = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in queries.queries()[name](spark, sf_dir).collect())
    assert get("players_per_frame", "clip_id", "frame_idx", "nb") == sorted((c, f, n) for c, at in counts.items() for f, n in at.items())
    want = []
    for c, at in counts.items():
        spans, opened, last = [], None, None
        for f, n in sorted(at.items()):
            if opened is None:
                opened, last = (f, f) if n >= start else (None, None)
            elif n >= end:
                last = f
            elif (f - last) / queries.FPS > pause:
                spans.append((opened, last))
                opened = None
        spans += [(opened, last)] if opened is not None else []
        kept = [(a, b) for a, b in spans if (b - a) / queries.FPS >= least]
        means = [np.mean([n for f, n in at.items() if a <= f <= b]) for a, b in kept]
        want += [(c, k, a, b, pytest.approx(m, abs=1e-6)) for k, ((a, b), m) in enumerate(zip(kept, means, strict=True))]
    assert get("actions", "clip_id", "action_idx", "frame_debut", "frame_fin", "nb_joueurs_moyen") == sorted(want, key=lambda r: r[:4])
    assert [r[:2] for r in get("clip_manifest", "clip_id", "action_idx", "debut_s")] == sorted(r[:2] for r in want)
    assert [r[2] for r in get("clip_manifest", "clip_id", "action_idx", "debut_s")] == [pytest.approx(r[2] / queries.FPS, abs=1e-6) for r in sorted(want, key=lambda r: r[:4])]


def test_homography():
    corners = {"A": ((100, 600), (0, 0)), "B": ((1000, 600), (40, 0)), "C": ((1000, 100), (40, 20)), "D": ((100, 100), (0, 20))}
    pairs = {k: {"pixel": p, "terrain_m": m} for k, (p, m) in corners.items()}
    h = homography.calibrate(pairs)
    assert h.method == "perspective_4pts" and homography._apply(np.array(h.h).reshape(3, 3), np.array([[550, 350]]))[0] == pytest.approx([20, 10], abs=1e-6)
    wrong = pairs | {"E": {"pixel": (550, 600), "terrain_m": (20, 0)}, "F": {"pixel": (550, 100), "terrain_m": (35, 3)}}
    h = homography.calibrate(wrong)
    assert h.method == "ransac" and homography._apply(np.array(h.h).reshape(3, 3), np.array([[550, 350]]))[0] == pytest.approx([20, 10], abs=1e-6)
    with pytest.raises(ValueError):
        homography.calibrate(dict(list(pairs.items())[:3]))


def test_correspondences(spark, tmp_path):
    path = tmp_path / "c.json"
    body = ", ".join(f'"{n}": {{"pixel": [{k}.9, 2], "terrain_m": [0, {k}]}}' for k, n in enumerate("ABCD"))
    path.write_text(f'{{"_comment": "x", {body}}}')
    assert correspondences.load_correspondences(spark, str(path))["B"] == {"pixel": (1, 2), "terrain_m": (0.0, 1.0)}
    for bad in ("[]", '{"A": 1, "B": 2, "C": 3, "D": 4}', '{"A": {"pixel": [1, 2], "terrain_m": [1, 2]}}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            correspondences.load_correspondences(spark, str(path))


def clip(frames):
    rows = [(1, f, k, *map(float, box), 0.9, 0) for f, boxes in frames for k, box in enumerate(boxes)]
    return pd.DataFrame(rows, columns=["clip_id", "frame_idx", "det_ord", "x1", "y1", "x2", "y2", "confidence", "class_id"])


def test_tracker():
    moving = clip([(f, [(10 + 2 * f, 10, 50 + 2 * f, 90)]) for f in range(20)])
    ids = tracking.track_clip(moving, tracking.TrackerConfig(), 25)
    assert set(ids) - {0} == {1}
    ghost = clip([(f, [(10, 10, 50, 90)] + ([(300, 300, 340, 380)] if f == 5 else [])) for f in range(15)])
    assert len(set(tracking.track_clip(ghost, tracking.TrackerConfig(), 25)) - {0}) == 1
    two = clip([(f, [(10, 10, 50, 90), (300, 300, 340, 380)]) for f in range(15)])
    assert len(set(tracking.track_clip(two, tracking.TrackerConfig(), 25)) - {0}) == 2
    gap = clip([(f, [(10, 10, 50, 90)]) for f in range(30) if not 10 <= f < 15])
    assert len(set(tracking.track_clip(gap, tracking.TrackerConfig(), 25)) - {0}) == 1


def test_appearance_cost_tells_crossing_boxes_apart():
    looks = np.eye(2).tolist()
    at = lambda f: [(10 + 4 * f, 10, 50 + 4 * f, 90), (50 - 4 * f, 10, 90 - 4 * f, 90)]
    rows = clip([(f, at(min(f, 5) if f < 6 else 10 - f)) for f in range(11)])  # they meet in frame 5 and turn back
    rows["embedding"] = [looks[k] for k in rows["det_ord"]]
    config = tracking.BACKENDS["botsort"]
    told = tracking.track_clip(rows, config, 25)
    assert [set(told[rows["det_ord"] == k]) - {0} for k in (0, 1)] in ([{1}, {2}], [{2}, {1}])
    # the same overlap with two boxes: only the looks say which is which
    pair = clip([(f, [(10, 10, 50, 90), (20, 10, 60, 90)]) for f in range(3)] + [(3, [(15, 10, 55, 90), (15, 10, 55, 90)])])
    for swapped in (False, True):
        pair["embedding"] = [looks[k ^ (swapped and f == 3)] for f, k in zip(pair["frame_idx"], pair["det_ord"], strict=True)]
        ids = tracking.track_clip(pair, config, 25)
        assert (ids[-2] == ids[-4]) == (not swapped) and (ids[-1] == ids[-3]) == (not swapped)


def test_botsort_query_uses_looks(spark):
    sf_dir = "/root/testdata/sf0.001"
    boxes = queries.Base(spark, sf_dir).boxes
    got = {tuple(r) for r in queries.queries()["botsort"](spark, sf_dir).collect()}
    blind = {tuple(r) for r in tracking.track_with(boxes, "botsort", queries.FPS).collect()}
    assert got and got != blind


def test_assignment_is_least_cost():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (2, 5), (5, 3)):
        cost = rng.random((n, m))
        small = min(n, m)
        best = min(sum(cost[i, j] for i, j in zip(rows, cols, strict=True)) for rows in permutations(range(n), small) for cols in permutations(range(m), small))
        assert sum(cost[i, j] for i, j in tracking.assign(cost, 10)) == pytest.approx(best)


def test_unknown_tracker(spark):
    with pytest.raises(ValueError):
        tracking.track_with(spark.range(1), "none", 25)


def test_teams(spark):
    rows = [(1, t, f, f * 10 + t, *((20.0, 20.0, 20.0 + f) if t % 2 else (200.0, 210.0, 220.0 + f))) for t in range(6) for f in range(4)]
    labelled = teams.two_colours(spark.createDataFrame(rows, "clip_id long, tracker_id long, frame_idx long, det_ord long, b double, g double, r double"))
    assert {(r.tracker_id, r.team) for r in teams.track_teams(labelled).collect()} == {(t, 1 - t % 2) for t in range(6)}


def test_torso_colour(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for box, (x1, y1, x2, y2) in enumerate([(0, 0, 10, 20), (5, 7, 26, 40), (3, 3, 4, 9), (2, 2, 2, 2)]):  # the last two have no torso
        inside = []
        for x in range(x1, max(x2, x1 + 1)):
            for y in range(y1, max(y2, y1 + 1)):
                bgr = [float(rng.randrange(256)) for _ in "bgr"]
                rows.append((1, 0, box, x, y, *bgr, x1, y1, x2, y2))
                w, h, cx = x2 - x1, y2 - y1, int((x1 + x2) / 2)
                if y1 + int(h * 0.15) <= y < y1 + int(h * 0.4) and cx - int(w * 0.2) <= x < cx + int(w * 0.2):
                    inside.append(bgr)
        want[box] = tuple(np.median(inside, axis=0)) if inside else (0.0, 0.0, 0.0)
    pixels = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_ord long, x long, y long, b double, g double, r double, x1 int, y1 int, x2 int, y2 int")
    assert {r.det_ord: (r.b, r.g, r.r) for r in teams.torso_colour(pixels).collect()} == want
    assert want[0] != (0, 0, 0) and want[3] == (0, 0, 0)


def test_torso_query_gives_every_box(spark):
    sf_dir = "/root/testdata/sf0.001"
    torso = [p for p in range(200) if 3 <= p // 10 < 8 and 3 <= p % 10 < 7]
    det = detections.detections_from_events(spark, sf_dir).collect()
    want = {(r.clip_id, r.frame_idx, r.det_ord, *(float(np.median([(p * n + r.det_ord) % 251 for p in torso])) for n in (3, 4, 5))) for r in det}
    got = queries.queries()["torso_median"](spark, sf_dir).select("clip_id", "frame_idx", "det_ord", "b", "g", "r").collect()
    assert len(got) == len(det) and {tuple(r) for r in got} == want


def test_metadata(spark):
    rows = [(1, f, 10 * f + t, t, t // 3, 2.0 * t + 0.1 * f, 10.0) for f in range(20) for t in (1, 2, 3)]
    det = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_ord long, tracker_id long, class_id int, x_m double, y_m double")
    frames = spark.createDataFrame([(1, f) for f in range(25)], "clip_id long, frame_idx long")
    team = spark.createDataFrame([(1, t, t % 2) for t in (1, 2)], "clip_id long, tracker_id long, team int")
    clips = spark.createDataFrame([(1, 50)], "clip_id long, nb_frames int")
    want = {
        "fps": 5.0, "subsample": 2, "max_gap_interpolation": 10, "cluster_mhb": 1, "min_frames_track": 3, "tracker": "botsort", "homographie_methode": "ransac",
        "homographie_nb_points": 6, "nb_frames_total": 50, "nb_frames_analysees": 25, "nb_trackers_total": 3, "nb_joueurs_classes": 2,
        "nb_joueurs_avant_filtre": 2, "nb_joueurs_stats": 2, "nb_reprises": 0, "nb_joueurs": 2, "longueur_moyenne": 20.0, "nb_actions_detectees": 0,
    }
    seen = match.analyse(det, frames, team, 5, 2, 3, 1, tracker="botsort", homography=homography.Homography([0.0] * 9, 6, "ransac"), clips=clips)
    got = one(seen.metadata).asDict()
    assert {k: got.get(k) for k in want} == want
    blank = one(match.analyse(det, frames, team, 5).metadata)
    assert (blank.tracker, blank.homographie_methode, blank.homographie_nb_points, blank.nb_frames_total) == (None,) * 4 and blank.fps == 5


def test_players_are_components(spark):
    positions = spark.createDataFrame([(c, t, 0, t, 1.0, 1.0, False) for c, ts in ((1, (1, 2, 3)), (2, (1, 2, 3, 4))) for t in ts], POSITIONS)
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 7, 8), (2, 1, 2), (2, 2, 3), (2, 3, 1), (3, 1, 2)], "clip_id long, a long, b long")
    got = {r.clip_id: (r.nb_tracks, r.nb_reprises, r.nb_joueurs) for r in tracks.player_estimate(positions, pairs).collect()}
    assert got == {1: (3, 3, 2), 2: (4, 3, 2)}
    assert {r.clip_id: r.nb_joueurs for r in tracks.player_estimate(positions, pairs.limit(0)).collect()} == {1: 3, 2: 4}


def test_low_stage_has_its_own_limit():
    """An unsure box that overlaps a track by less than a half never continues it, whether or not sure boxes matched in its frame."""
    for sure in ([], [(300, 300, 340, 380)]):
        rows = clip([(f, [(10, 10, 50, 90), *sure]) for f in range(4)] + [(4, [(35, 10, 75, 90), *sure])])
        rows.loc[(rows.frame_idx == 4) & (rows.x1 == 35), "confidence"] = 0.2
        ids = tracking.track_clip(rows, tracking.TrackerConfig(), 25)
        assert ids[(rows.frame_idx == 4) & (rows.x1 == 35)].tolist() == [0]
    near = rows.copy()
    near.loc[(near.frame_idx == 4) & (near.x1 == 35), ["x1", "x2"]] = (15, 55)
    assert tracking.track_clip(near, tracking.TrackerConfig(), 25)[(near.frame_idx == 4) & (near.x1 == 15)].tolist() != [0]


def test_suppress(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(120):
        x, y = rng.integers(0, 60, 2)
        rows.append((1, int(n % 4), n, float(x), float(y), float(x + 20), float(y + 30), round(float(rng.integers(1, 6)) / 10, 1), int(n % 3 == 0)))
    det = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_ord long, x1 float, y1 float, x2 float, y2 float, confidence double, class_id int")
    for most in (0.2, 0.5):
        want = set()
        for key in {(r[1], r[8]) for r in rows}:
            stay = []
            for r in sorted((r for r in rows if (r[1], r[8]) == key), key=lambda r: (-r[7], r[2])):
                if all(tracking.iou(np.array([r[3:7]]), np.array([s[3:7]]))[0, 0] <= most for s in stay):
                    stay.append(r)
            want |= {r[2] for r in stay}
        assert {r.det_ord for r in detections.suppress(det, most).collect()} == want


def test_from_boxes_to_results(spark, tmp_path):
    """Boxes of two players and a referee walk over the court; all results, through files."""
    rows = []
    for f in range(60):
        for t, (y, c) in enumerate(((200, 0), (300, 0), (150, 2))):
            x = 100 + 4 * f
            rows.append((1, f, 3 * f + t, x - 10.0, y - 60.0, x + 10.0, float(y), 0.9, c))
    boxes = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_ord long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    frames = boxes.select("clip_id", "frame_idx").distinct()
    torsos = boxes.select("clip_id", "frame_idx", "det_ord", *(F.when(F.col("y2") == 200, 20.0).otherwise(200.0).alias(c) for c in "bgr"))
    pairs = {n: {"pixel": p, "terrain_m": m} for n, p, m in (("A", (0, 0), (0, 0)), ("B", (800, 0), (40, 0)), ("C", (800, 400), (40, 20)), ("D", (0, 400), (0, 20)))}
    done = match.analyse_boxes(boxes, frames, 10.0, homography.calibrate(pairs), torsos=torsos, tracker="botsort")
    match.write(done, str(tmp_path))
    stats_ = spark.read.parquet(f"{tmp_path}/stats_joueurs.parquet").collect()
    assert len(stats_) == 2 and all(abs(r.vitesse_moyenne_m_s - 2.0) < 0.05 for r in stats_)
    assert spark.read.csv(f"{tmp_path}/stats_joueurs.csv", header=True).count() == 2
    assert {r.equipe for r in match.read_block_width(spark, str(tmp_path)).collect()} == {"MHB", "ADV"}
    meta = match.metadata_dicts(done)[1]
    assert meta["tracker"] == "botsort" and meta["homographie_nb_points"] == 4 and meta["nb_trackers_total"] == 3 and meta["nb_joueurs_classes"] == 2
    assert meta["longueur_track_moyenne"] == 59.0 and meta["nb_joueurs_estimes"] == 2
    assert stats.longest(done.stats, 1).count() == 1 and match.detection_seconds(1500, 2) == 30.0
    boxes.write.parquet(f"{tmp_path}/boxes")
    frames.write.parquet(f"{tmp_path}/frames")
    (tmp_path / "h.json").write_text(__import__("json").dumps(pairs))
    from rallygrid.cli import main

    given = ["analyse", "--detections", f"{tmp_path}/boxes", "--frames", f"{tmp_path}/frames", "--output", f"{tmp_path}/out", "--fps", "10", "--subsample", "1"]
    assert main([*given, "--homographie", f"{tmp_path}/h.json", "--tracker", "bytetrack"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/stats_joueurs.parquet").count() == 2 and (tmp_path / "out/clips.parquet").exists()
    assert main(given) == 2 and main([*given, "--homographie", f"{tmp_path}/none.json"]) == 1


def test_class_names(spark):
    from rallygrid.functions.scalar import class_name

    got = spark.range(5).select(class_name(F.col("id").cast("int")).alias("name")).collect()
    assert [r.name for r in got] == ["players", "goalkeeper", "referees", "ball", None]


def test_scans(spark):
    frames = spark.range(40).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("frame_idx"))
    assert one(detections.batches(detections.sample_frames(frames, 2))).n_batches == 3
    assert detections.sample_frames(frames, 1, 10).count() == 10
    with pytest.raises(ValueError):
        detections.sample_frames(frames, 0)
    with pytest.raises(Exception, match="unreadable clip 3"):
        detections.check_clips(spark.createDataFrame([(3, 0.0, 5)], "clip_id long, fps double, nb_frames int")).collect()


def test_court():
    assert COURT.origin == (40, 50)


def test_cli_rejects_bad_arguments():
    from rallygrid.cli import main

    assert main(["analyse", "--detections", "d", "--frames", "f", "--teams", "t", "--output", "o", "--fps", "0"]) == 2


def test_entry_without_the_training_data_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "rallygrid", tmp_path / "rallygrid", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'player_stats' in q and not any(n.startswith('op') for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
