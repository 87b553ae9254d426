"""DuckDB SQL for the queries over the derived detection table."""

from __future__ import annotations

import math

#: Common table expressions, each naming those it needs.
_CTES: dict[str, tuple[str, str]] = {
    "b": ("", """SELECT event_id, event_id // 2000 AS clip_id, ((event_id % 2000) // 10) * 2 AS frame_idx, user_id % 40 AS slot,
        (event_id % 2000) // 500 AS seg, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 1e2) AS BIGINT) AS c FROM events"""),
    "det": ("b", """SELECT clip_id, frame_idx, event_id AS det_ord, slot * 4 + seg AS tracker_id,
        CASE WHEN slot % 10 = 8 THEN 1 WHEN slot % 10 = 9 THEN 2 WHEN event_type = 'error' AND k < 50 THEN 3 ELSE 0 END AS class_id,
        CAST((slot * 7) % 40 + CASE WHEN k >= 95 THEN 15 ELSE 0 END AS DOUBLE) + (c % 300) / 1e2 AS x_m,
        CAST((slot * 3) % 20 AS DOUBLE) + k / 5e1 AS y_m, k
        FROM b QUALIFY row_number() OVER (PARTITION BY clip_id, slot, seg, frame_idx ORDER BY event_id) = 1"""),
    "frames": ("det", "SELECT DISTINCT clip_id, frame_idx FROM det"),
    "tc": ("det", """SELECT clip_id, tracker_id, class_id FROM (SELECT clip_id, tracker_id, class_id, count(*) AS n, min(det_ord) AS f FROM det GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY clip_id, tracker_id ORDER BY n DESC, f) = 1"""),
    "pl": ("tc", "SELECT d.clip_id, d.tracker_id, d.frame_idx, d.det_ord, d.x_m, d.y_m FROM det d JOIN tc USING (clip_id, tracker_id) WHERE tc.class_id = 0"),
    "pos": ("pl", "SELECT * FROM pl WHERE x_m BETWEEN 0 AND 40 AND y_m BETWEEN 2 AND 18"),
    "team": ("det", "SELECT DISTINCT clip_id, tracker_id, CAST(tracker_id % 2 AS INT) AS team FROM det"),
    "ahead": ("pos", """SELECT *, lead(frame_idx) OVER w AS nf, lead(x_m) OVER w AS nx, lead(y_m) OVER w AS ny, lead(frame_idx) OVER w - frame_idx AS gap
        FROM pos WINDOW w AS (PARTITION BY clip_id, tracker_id ORDER BY frame_idx, det_ord)"""),
    "filled": ("ahead", """SELECT clip_id, tracker_id, frame_idx, det_ord, x_m, y_m, false AS interpole FROM pos UNION ALL
        SELECT clip_id, tracker_id, frame_idx + k, NULL, x_m + (CAST(k AS DOUBLE) / gap) * (nx - x_m), y_m + (CAST(k AS DOUBLE) / gap) * (ny - y_m), true
        FROM (SELECT *, unnest(range(1, gap)) AS k FROM ahead WHERE gap BETWEEN 2 AND 10)"""),
    "bounds": ("pos", """SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY first_ord) AS track_ord FROM (
        SELECT clip_id, tracker_id, count(*) AS n_real, min(det_ord) AS first_ord, min(frame_idx) AS first_frame, arg_min(x_m, det_ord) AS first_x,
        arg_min(y_m, det_ord) AS first_y, max(frame_idx) AS last_frame, arg_max(x_m, det_ord) AS last_x, arg_max(y_m, det_ord) AS last_y FROM pos GROUP BY ALL)"""),
    "cand": ("bounds", """SELECT e.clip_id, e.tracker_id AS a, s.tracker_id AS b, e.track_ord AS ord_a, s.track_ord AS ord_b, e.last_frame, s.first_frame - e.last_frame AS gap,
        sqrt((s.first_x - e.last_x) * (s.first_x - e.last_x) + (s.first_y - e.last_y) * (s.first_y - e.last_y)) AS dist_m
        FROM bounds e JOIN bounds s ON e.clip_id = s.clip_id AND e.tracker_id <> s.tracker_id AND s.first_frame - e.last_frame BETWEEN 1 AND 30
        WHERE sqrt((s.first_x - e.last_x) * (s.first_x - e.last_x) + (s.first_y - e.last_y) * (s.first_y - e.last_y)) <= 3"""),
    "ends": ("cand", """SELECT clip_id, a, list(b ORDER BY dist_m, ord_b) AS starts, row_number() OVER (PARTITION BY clip_id ORDER BY min(last_frame), min(ord_a)) AS i
        FROM cand GROUP BY clip_id, a"""),
    "fold": ("ends", """SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT clip_id FROM ends)
        UNION ALL SELECT clip_id, i, a, b, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b) END FROM (
        SELECT f.clip_id, e.i, e.a, f.taken, list_filter(e.starts, lambda s: NOT list_contains(f.taken, s))[1] AS b FROM fold f JOIN ends e ON e.clip_id = f.clip_id AND e.i = f.i + 1)"""),
    "pairs": ("fold", "SELECT clip_id, a, b FROM fold WHERE b IS NOT NULL"),
    "estimate": ("pairs", """SELECT t.clip_id, t.n AS nb_tracks, coalesce(r.n, 0) AS nb_reprises, t.n - coalesce(r.n, 0) AS nb_joueurs
        FROM (SELECT clip_id, count(DISTINCT tracker_id) AS n FROM pos GROUP BY 1) t LEFT JOIN (SELECT clip_id, count(*) AS n FROM pairs GROUP BY 1) r USING (clip_id)"""),
    "counts": ("frames tc", """SELECT f.clip_id, f.frame_idx, count(d.det_ord) AS nb FROM frames f LEFT JOIN (
        SELECT d.* FROM det d JOIN tc USING (clip_id, tracker_id) WHERE tc.class_id = 0) d USING (clip_id, frame_idx) GROUP BY ALL"""),
    "colours": ("tc team", """SELECT clip_id, tracker_id, CASE class_id WHEN 1 THEN 0 WHEN 2 THEN 255 WHEN 0 THEN CASE WHEN team = 0 THEN 0 ELSE 0 END ELSE 128 END AS b,
        CASE class_id WHEN 1 THEN 215 WHEN 2 THEN 0 WHEN 0 THEN CASE WHEN team = 0 THEN 255 ELSE 0 END ELSE 128 END AS g,
        CASE class_id WHEN 1 THEN 255 WHEN 2 THEN 255 WHEN 0 THEN CASE WHEN team = 0 THEN 0 ELSE 255 END ELSE 128 END AS r
        FROM tc LEFT JOIN team USING (clip_id, tracker_id)"""),
    "boxes": ("det", """SELECT *, CAST(x_m * 20 + 50 - 10 AS FLOAT) AS x1, CAST(y_m * 20 + 60 - 60 AS FLOAT) AS y1, CAST(x_m * 20 + 50 + 10 AS FLOAT) AS x2, CAST(y_m * 20 + 60 AS FLOAT) AS y2, k / 1e2 AS confidence FROM det"""),
}


def _action_ctes(name: str, start: int, end: int, least: float, pause: float) -> dict[str, tuple[str, str]]:
    """Actions by these thresholds, as the expression ``name``."""
    return {
        f"{name}_marked": ("counts", f"""SELECT *, lag(frame_idx) OVER w AS before,
            max(CASE WHEN nb >= {end} THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
            FROM counts WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)"""),
        f"{name}_islands": (f"{name}_marked", f"""SELECT *, sum(CASE WHEN nb >= {end} AND before > last AND (before - last) / 5e0 > {pause:e} THEN 1 ELSE 0 END)
            OVER (PARTITION BY clip_id ORDER BY frame_idx) AS island FROM {name}_marked"""),
        f"{name}_spans": (f"{name}_islands", f"""SELECT clip_id, island, min(frame_idx) FILTER (nb >= {start}) AS frame_debut, max(frame_idx) AS frame_fin FROM {name}_islands WHERE nb >= {end}
            GROUP BY ALL HAVING (max(frame_idx) - min(frame_idx) FILTER (nb >= {start})) / 5e0 >= {least:e}"""),
        name: (f"{name}_spans", f"""SELECT s.clip_id, s.frame_debut, s.frame_fin, (s.frame_fin - s.frame_debut) / 5e0 AS duree_s, avg(i.nb) AS nb_joueurs_moyen,
            row_number() OVER (PARTITION BY s.clip_id ORDER BY s.frame_debut) - 1 AS action_idx FROM {name}_spans s
            JOIN {name}_islands i ON i.clip_id = s.clip_id AND i.island = s.island AND i.frame_idx BETWEEN s.frame_debut AND s.frame_fin GROUP BY s.clip_id, s.frame_debut, s.frame_fin"""),
    }


_CTES |= _action_ctes("acts", 8, 7, 1.0, 0.7) | _action_ctes("plain_acts", 6, 4, 3.0, 3.0)


def _r(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def _with(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in _CTES[name][0].split():
            add(need)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + body


def _stats(rows: str, cap: str | None) -> str:
    top = f"coalesce(max(v) FILTER (v <= {cap}), {cap})" if cap else "max(v)"
    mean = "CASE WHEN max(frame_idx) > min(frame_idx) THEN coalesce(sum(step), 0) / ((max(frame_idx) - min(frame_idx)) / 5e0) ELSE 0 END"
    return f"""SELECT clip_id, tracker_id, {_r("coalesce(sum(step), 0)")} AS distance_parcourue_m, {_r(mean)} AS vitesse_moyenne_m_s,
      {_r(f"CASE WHEN count(v) > 0 THEN {top} ELSE 0 END")} AS vitesse_max_m_s, {_r("(max(frame_idx) - min(frame_idx)) / 5e0")} AS temps_total_s,
      {_r("min(x_m)")} AS x_min, {_r("max(x_m)")} AS x_max, {_r("min(y_m)")} AS y_min, {_r("max(y_m)")} AS y_max,
      {_r("avg(x_m)")} AS centroide_x, {_r("avg(y_m)")} AS centroide_y, count(*) AS nb_frames_detectees
    FROM (SELECT *, step / CASE WHEN gap > 0 THEN gap / 5e0 ELSE 2e-1 END AS v FROM (
      SELECT *, sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)) AS step, frame_idx - lag(frame_idx) OVER w AS gap
      FROM {rows} WINDOW w AS (PARTITION BY clip_id, tracker_id ORDER BY frame_idx, det_ord))) GROUP BY clip_id, tracker_id"""


def _width(team: int, tag: str = "") -> str:
    return f"""SELECT clip_id, frame_idx, {_r("max(y_m) - min(y_m)")} AS largeur_y_m, {_r("avg(x_m)")} AS x_moyen, count(*) AS nb_defenseurs_visibles,
      {_r("frame_idx / 5e0")} AS temps_s{tag} FROM pos JOIN team USING (clip_id, tracker_id) WHERE team = {team} GROUP BY clip_id, frame_idx"""


def _heat(rows: str, resolution: float, sigma: float | None) -> str:
    nx, ny = round(40 / resolution), round(20 / resolution)
    grid = f"""SELECT clip_id, tracker_id, CAST(floor(greatest(0, least(y_m / {resolution:e}, {ny - 1}))) AS INT) AS iy,
      CAST(floor(greatest(0, least(x_m / {resolution:e}, {nx - 1}))) AS INT) AS ix, CAST(count(*) AS DOUBLE) AS w FROM {rows} GROUP BY ALL"""
    if sigma:
        r = int(4 * sigma + 0.5)
        raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
        kernel = "(VALUES " + ", ".join(f"({k}, {v / sum(raw)!r}::DOUBLE)" for k, v in zip(range(-r, r + 1), raw, strict=True)) + ") AS kernel(d, g)"
        grid = f"SELECT clip_id, tracker_id, iy, ix + d AS ix, sum(w * g) AS w FROM ({grid}), {kernel} WHERE ix + d BETWEEN 0 AND {nx - 1} GROUP BY ALL"
        grid = f"SELECT clip_id, tracker_id, iy + d AS iy, ix, sum(w * g) AS w FROM ({grid}), {kernel} WHERE iy + d BETWEEN 0 AND {ny - 1} GROUP BY ALL"
    return f"SELECT clip_id, tracker_id, iy, ix, {_r('w / sum(w) OVER (PARTITION BY clip_id, tracker_id)')} AS densite FROM ({grid})"


_TOP = "SELECT clip_id, tracker_id, count(*) AS nb_frames_detectees FROM pos GROUP BY clip_id, tracker_id QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, tracker_id) = 1"
_NAMES = "(VALUES (0, 'Ball'), (1, ' goalkeepers '), (2, 'PLAYER'), (3, 'referee'), (4, 'crowd')) AS names(class_id, name)"
_KEY = r"regexp_replace(trim(translate(lower(trim(name)), '_-', '  ')), '^(.+)s$', '\1')"
_RADAR = "40 + CAST(round_even(greatest(0e0, least(x_m, 4e1)) * 22, 0) AS INT) AS cx, 50 + CAST(round_even((2e1 - greatest(0e0, least(y_m, 2e1))) * 22, 0) AS INT) AS cy"


def _project(more: str = "", rounded: bool = True) -> str:
    h = ["0.04", "0.002", "-1.5", "-0.001", "0.05", "0.25", "0.0001", "0.0002", "1.0"]
    row = [f"({h[k]}::DOUBLE * px + {h[k + 1]}::DOUBLE * py + {h[k + 2]}::DOUBLE)" for k in (0, 3, 6)]
    show = _r if rounded else str
    return f"""SELECT clip_id, {more}det_ord, {show("px")} AS px, {show("py")} AS py, {show(f"CAST(CAST({row[0]} / {row[2]} AS FLOAT) AS DOUBLE)")} AS x, {show(f"CAST(CAST({row[1]} / {row[2]} AS FLOAT) AS DOUBLE)")} AS y
      FROM (SELECT clip_id, {more}det_ord, CAST(CAST((x1 + x2) / 2::FLOAT AS FLOAT) AS DOUBLE) AS px, CAST(y2 AS DOUBLE) AS py FROM boxes)"""


def _metadata() -> str:
    """Without short tracks taken out, statistics count the tracks that quality counts."""
    part = lambda name, rows: f"(SELECT clip_id, count(*) AS {name} FROM {rows} GROUP BY 1)"
    counted = {
        "nb_trackers_total": "tc", "nb_joueurs_classes": "(SELECT DISTINCT clip_id, tracker_id FROM team)", "nb_joueurs_avant_filtre": "bounds",
        "nb_joueurs_stats": "bounds", "nb_actions_detectees": "plain_acts", "nb_frames_analysees": "frames",
    }
    joins = "".join(f" LEFT JOIN {part(n, rows)} USING (clip_id)" for n, rows in counted.items())
    return f"""SELECT clip_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in (*counted, "nb_tracks", "nb_reprises", "nb_joueurs"))}, {_r("coalesce(longueur_moyenne, 0)")} AS longueur_moyenne,
      5e0 AS fps, 1 AS subsample, 5 AS max_gap_interpolation, CAST(NULL AS VARCHAR) AS homographie_methode, CAST(NULL AS INT) AS homographie_nb_points, 0 AS cluster_mhb,
      CAST(NULL AS VARCHAR) AS tracker, 0 AS min_frames_track, CAST(NULL AS BIGINT) AS nb_frames_total
      FROM (SELECT DISTINCT clip_id FROM tc){joins} LEFT JOIN estimate USING (clip_id) LEFT JOIN (SELECT clip_id, avg(n_real) AS longueur_moyenne FROM bounds GROUP BY 1) USING (clip_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "subsample_frames": _with("frames", "SELECT clip_id, count(*) AS n_frames, CAST(ceil(count(*) / 8e0) AS BIGINT) AS n_batches FROM frames WHERE frame_idx % 4 = 0 AND frame_idx < 300 GROUP BY 1"),
        "class_name_normalize": f"SELECT class_id, {_KEY} AS cle FROM {_NAMES}",
        "class_remap": _with("det", "SELECT clip_id, det_ord, CASE class_id WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS class_id FROM det WHERE class_id <= 3"),
        "class_remap_empty_passthrough": _with("det", "SELECT clip_id, det_ord, class_id FROM det"),
        "confidence_class_filter": _with("boxes", "SELECT clip_id, det_ord, class_id FROM boxes WHERE confidence >= 35e-2 AND class_id = 0"),
        "class_vote": _with("tc", "SELECT * FROM tc"),
        "player_filter": _with("pl", "SELECT * FROM pl"),
        "zone_filter": _with("det", "SELECT clip_id, det_ord, x_m, y_m FROM det WHERE x_m BETWEEN 0 AND 40 AND y_m BETWEEN 2 AND 18"),
        "project_feet": _with("boxes", _project()),
        "project_positions": _with("boxes tc", f"""SELECT clip_id, tracker_id, frame_idx, det_ord, {_r("x")} AS x_m, {_r("y")} AS y_m FROM (
            SELECT p.* FROM ({_project("tracker_id, frame_idx, ", rounded=False)}) p JOIN tc USING (clip_id, tracker_id) WHERE class_id = 0) WHERE x BETWEEN 0 AND 40 AND y BETWEEN 2 AND 18"""),
        "run_metadata": _with("plain_acts estimate bounds team frames", _metadata()),
        "short_track_filter": _with("pos", "SELECT * FROM pos QUALIFY count(*) OVER (PARTITION BY clip_id, tracker_id) >= 10"),
        "interpolate_gaps": _with("filled", "SELECT clip_id, tracker_id, frame_idx, x_m, y_m, interpole FROM filled"),
        "player_stats": _with("pos", _stats("pos", "12e0")),
        "player_stats_uncapped": _with("pos", _stats("pos", None)),
        "player_stats_with_interpolated": _with("filled", _stats("filled", "12e0")),
        "defensive_block_width": _with("pos team", _width(0)),
        "block_width_union": _with("pos team", _width(0, ", 'MHB' AS equipe") + " UNION ALL " + _width(1, ", 'ADV' AS equipe")),
        "players_per_frame": _with("counts", "SELECT * FROM counts"),
        "actions": _with("acts", f"SELECT clip_id, action_idx, frame_debut, frame_fin, {_r('duree_s')} AS duree_s, {_r('nb_joueurs_moyen')} AS nb_joueurs_moyen, CAST(NULL AS INT) AS equipe_en_attaque FROM acts"),
        "clip_manifest": _with("acts", f"SELECT clip_id, action_idx, printf('action_%03d_%.1fs.mp4', action_idx, duree_s) AS fichier, {_r('frame_debut / 5e0')} AS debut_s, {_r('duree_s')} AS duree_s FROM acts"),
        "track_bounds": _with("bounds", "SELECT * EXCLUDE (first_ord) FROM bounds"),
        "id_resume_candidates": _with("cand", f"SELECT clip_id, a, b, gap, {_r('dist_m')} AS dist_m FROM cand"),
        "id_resume_pairs": _with("pairs", "SELECT * FROM pairs"),
        "player_count_estimate": _with("estimate", "SELECT * FROM estimate"),
        "tracking_quality": _with("estimate bounds", f"SELECT e.*, m.longueur_moyenne FROM estimate e JOIN (SELECT clip_id, {_r('avg(n_real)')} AS longueur_moyenne FROM bounds GROUP BY 1) m USING (clip_id)"),
        "heatmap_raw": _with("pos", _heat("pos", 0.5, None)),
        "heatmap_smoothed": _with("pos", _heat("pos", 1.0, 1.0)),
        "top_tracker": _with("pos", _TOP),
        "top_tracker_heatmap": _with("pos", _heat(f"(SELECT p.* FROM pos p JOIN ({_TOP}) t USING (clip_id, tracker_id))", 0.5, 1.5)),
        "tracker_color": _with("colours", "SELECT * FROM colours"),
        "radar_plan": _with("pos colours", f"SELECT p.*, cx + 11 AS label_x, cy + 4 AS label_y, b, g, r FROM (SELECT clip_id, tracker_id, frame_idx, {_RADAR} FROM pos) p LEFT JOIN colours USING (clip_id, tracker_id)"),
        "box_render_plan": _with("boxes", "SELECT *, greatest(0, y1 - 5) AS label_y FROM (SELECT clip_id, tracker_id, frame_idx, CAST(trunc(x1 * 75e-2) AS INT) AS x1, CAST(trunc(y1 * 5e-1) AS INT) AS y1, CAST(trunc(x2 * 75e-2) AS INT) AS x2, CAST(trunc(y2 * 5e-1) AS INT) AS y2 FROM boxes)"),
        "frame_semi_join": _with("frames", "SELECT * FROM frames SEMI JOIN (SELECT clip_id, frame_idx FROM det WHERE k < 5) USING (clip_id, frame_idx)"),
        "team_vote": _with("det", """SELECT clip_id, tracker_id, team FROM (SELECT clip_id, tracker_id, CAST(k % 2 AS INT) AS team, count(*) AS n, min(det_ord) AS f FROM det GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY clip_id, tracker_id ORDER BY n DESC, f) = 1"""),
        "correspondences_json": "SELECT * FROM (VALUES (1, 'A', 100, 200, 0e0, 0e0), (1, 'B', 1000, 100, 4e1, 205e-1)) AS t(clip_id, name, px, py, xm, ym)",
        "torso_median": _with("det", """SELECT clip_id, frame_idx, det_ord, median((p * 3 + det_ord) % 251) AS b, median((p * 4 + det_ord) % 251) AS g, median((p * 5 + det_ord) % 251) AS r
            FROM (SELECT *, unnest(range(200)) AS p FROM det) WHERE p // 10 >= 3 AND p // 10 < 8 AND p % 10 >= 3 AND p % 10 < 7 GROUP BY clip_id, frame_idx, det_ord"""),
    }
