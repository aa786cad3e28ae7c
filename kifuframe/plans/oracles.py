"""DuckDB SQL that computes each registered query from the same tables.

The SQL is written independently of the operators: windows and joins over exploded
rows where the operators use array columns.
"""

from __future__ import annotations

from kifuframe.plans.fixtures import RESULTS, TREE_ARITY

MOVES = """
moves AS (
  SELECT user_id AS game_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
mv AS (
  SELECT game_id, ply, k, CAST(k // 9 AS INTEGER) AS row, CAST(k % 9 AS INTEGER) AS col,
         CASE WHEN ply % 2 = 0 THEN 'B' ELSE 'W' END AS color
  FROM moves)"""

_RESULT_LIST = "[" + ", ".join(f"'{r}'" for r in RESULTS) + "]"
_OUTCOME_LIST = "[1, -1, 0, 0, 1, -1, 0, 1, 1, -1, 0, 0]"

GAMES = f"""
gm AS (
  SELECT game_id,
         CAST(CASE WHEN game_id % 10 = 0 THEN 19 ELSE 9 END AS INTEGER) AS board_size,
         {_RESULT_LIST}[1 + game_id % 12] AS result,
         CAST({_OUTCOME_LIST}[1 + game_id % 12] AS INTEGER) AS outcome,
         'P' || (game_id % 7) AS black_player, 'P' || (game_id % 5) AS white_player,
         '2024-01-' || lpad(CAST(game_id % 28 + 1 AS VARCHAR), 2, '0') AS game_date,
         CASE WHEN game_id % 2 = 0 THEN 6.5 ELSE 7.5 END::DOUBLE AS komi
  FROM (SELECT DISTINCT user_id AS game_id FROM events))"""

RECORDS = f"""{MOVES}, {GAMES},
parts AS (
  SELECT game_id, CAST(0 AS INTEGER) AS part,
         string_agg(';' || color || '[' || chr(97 + col) || chr(97 + row) || ']', '' ORDER BY ply) AS body
  FROM mv GROUP BY ALL),
rec AS (
  SELECT game_id, part, '(;FF[4]SZ[' || board_size || ']RE[' || result || ']PB[' || black_player || ']PW['
         || white_player || ']DT[' || game_date || ']KM[' || komi || ']'
         || CASE WHEN game_id % 7 = 0 THEN 'KM[0.5]' ELSE '' END
         || CASE WHEN game_id % 9 = 0 THEN 'PC[Tokyo]' ELSE '' END
         || CASE WHEN game_id % 6 = 0 THEN 'AB[ee]' ELSE '' END
         || CASE WHEN game_id % 5 = 0 THEN 'C[x [n] y]' ELSE '' END
         || body || CASE WHEN game_id % 4 = 0 THEN ';W[tt]' ELSE '' END || ')' AS text
  FROM parts JOIN gm USING (game_id)),
stripped AS (
  SELECT game_id, part, regexp_replace(text, 'C\\[[^\\[\\]]*(\\[[^\\[\\]]*\\][^\\[\\]]*)*\\]', '', 'g') AS body FROM rec)"""


def _record_moves(pattern: str) -> str:
    return f"""{RECORDS},
found AS (
  SELECT game_id, part, unnest(regexp_extract_all(body, '{pattern}', 1)) AS color,
         unnest(regexp_extract_all(body, '{pattern}', 2)) AS coord,
         unnest(range(len(regexp_extract_all(body, '{pattern}', 1)))) AS pos FROM stripped),
rmv AS (
  SELECT game_id, part, CAST(pos AS INTEGER) AS ply, color, coord,
         CAST(ascii(coord[2]) - 97 AS INTEGER) AS row, CAST(ascii(coord[1]) - 97 AS INTEGER) AS col FROM found)"""


RECORD_MOVES = _record_moves("([BW])\\[([a-s]{2})\\]")
# RE2 has no look-behind: the character before is matched along; every setup or header
# key in the records ends a node whose moves follow a ';', so nothing is skipped.
STRICT_MOVES = _record_moves("[^A-Z]([BW])\\[([a-s]{2})\\]")


def _replay(source: str, keys: str, n: str = "9") -> str:
    return f"""
touched AS (
  SELECT *, row < {n} AND col < {n} AS in_bounds,
         row < {n} AND col < {n} AND row_number() OVER (PARTITION BY {keys}, row, col ORDER BY ply) = 1 AS accepted
  FROM {source}),
rp AS (
  SELECT *, CAST(CASE WHEN in_bounds THEN row * {n} + col END AS INTEGER) AS cell,
         CAST(coalesce(sum(CAST(accepted AS INTEGER)) OVER (
           PARTITION BY {keys} ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS n_before,
         CAST(CASE WHEN n_before % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS player
  FROM touched)"""


REPLAY = f"{MOVES}, {_replay('mv', 'game_id')}"
LOADED = f"""{RECORD_MOVES},
loaded AS (
  SELECT game_id, part, board_size, result,
         CASE WHEN game_id % 7 = 0 THEN 6.5::DOUBLE ELSE komi END AS komi, CAST(count(*) AS INTEGER) AS n_moves,
         'd' || (game_id % 10) || '/' || game_id || '-' || part
         || CASE WHEN game_id % 2 = 0 THEN '.sgf' ELSE '.SGF' END AS path
  FROM rmv JOIN gm USING (game_id) GROUP BY ALL)"""
RECORD_GAMES = f"{RECORD_MOVES}, sized AS (SELECT rmv.*, board_size AS bs FROM rmv JOIN gm USING (game_id))"
RECORD_REPLAY = f"{RECORD_GAMES}, {_replay('sized', 'game_id, part', 'bs')}"

BOARD = f"""{REPLAY},
stones AS (SELECT game_id, ply AS placed, cell, player AS color FROM rp WHERE accepted),
seen AS (
  SELECT r.game_id, r.ply, r.player, s.cell, s.color
  FROM rp r JOIN stones s ON r.game_id = s.game_id AND s.placed < r.ply),
views AS (
  SELECT game_id, ply, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (color = player) AS own,
         string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (color <> player) AS opp
  FROM seen GROUP BY game_id, ply),
pos AS (
  SELECT r.*, coalesce(own, '') AS own_cells, coalesce(opp, '') AS opp_cells
  FROM rp r LEFT JOIN views USING (game_id, ply))"""

GAME_END = f"""{REPLAY},
ended AS (
  SELECT game_id, CAST(count(*) FILTER (accepted AND player = 1) AS INTEGER) AS black,
         CAST(count(*) FILTER (accepted AND player = -1) AS INTEGER) AS white,
         CAST(count(*) AS INTEGER) AS n_moves,
         string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (accepted AND player = 1) AS black_cells,
         string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (accepted AND player = -1) AS white_cells
  FROM rp GROUP BY game_id)"""

# the eight symmetries on an n x n board, by (row, col) -> to_cell
def _symmetry(tid: str, row: str, col: str, n: int) -> str:
    e = n - 1
    images = [
        f"{row} * {n} + {col}", f"({e} - {col}) * {n} + {row}", f"({e} - {row}) * {n} + {e} - {col}",
        f"{col} * {n} + {e} - {row}", f"{row} * {n} + {e} - {col}", f"({e} - {row}) * {n} + {col}",
        f"{col} * {n} + {row}", f"({e} - {col}) * {n} + {e} - {row}",
    ]
    whens = " ".join(f"WHEN {i} THEN {image}" for i, image in enumerate(images))
    return f"CAST(CASE {tid} {whens} END AS INTEGER)"


TIDS = "tids AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS transform_id)"


def _turned_views(base: str, prefix: str = "") -> str:
    """Stones of every position of ``base`` under all symmetries, as text."""
    to_cell = _symmetry("transform_id", "(cell // 9)", "(cell % 9)", 9)
    return f"""
{prefix}turned AS (
  SELECT game_id, ply, transform_id, color = player AS own, {to_cell} AS cell FROM {base}, tids),
{prefix}tviews AS (
  SELECT game_id, ply, transform_id,
         string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (own) AS own,
         string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (NOT own) AS opp
  FROM {prefix}turned GROUP BY game_id, ply, transform_id)"""


EXAMPLES = f"""{BOARD}, {GAMES},
exs AS (
  SELECT p.*, p.cell AS action, CAST(sign(outcome) * player AS DOUBLE) AS value
  FROM pos p JOIN gm USING (game_id) WHERE in_bounds)"""

TRANSITIONS = f"""{REPLAY}, {GAMES},
acc AS (
  SELECT game_id, n_before AS ply, player, cell AS action,
         (n_before % 2) / 81.0::DOUBLE * player AS diff, outcome
  FROM rp JOIN gm USING (game_id) WHERE accepted),
tr AS (
  SELECT *, coalesce(lead(ply) OVER w, ply) AS next_ply, lead(ply) OVER w IS NULL AS done,
         coalesce(lead(diff) OVER w, diff) AS next_value
  FROM acc WINDOW w AS (PARTITION BY game_id ORDER BY ply)),
nst AS (
  SELECT a.game_id, a.ply, sum(pow(0.99, b.ply - a.ply) * b.diff) AS n_step
  FROM acc a JOIN acc b ON a.game_id = b.game_id AND b.ply BETWEEN a.ply AND a.ply + 4
  GROUP BY a.game_id, a.ply),
rw AS (
  SELECT tr.*, n_step, CASE WHEN done THEN diff + outcome ELSE n_step END AS reward
  FROM tr JOIN nst USING (game_id, ply))"""

REPLAY_ROWS = """
rep AS (SELECT event_id AS seq, user_id, event_type, value / 100 + 1e-6 AS priority FROM events),
pr AS (SELECT *, pow(priority, 0.6) AS w, pow(priority, 0.6) / sum(pow(priority, 0.6)) OVER () AS prob FROM rep),
un AS (SELECT *, CAST('0x' || substr(md5(seq || ':7'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pr)"""

LOGITS = """
lg AS (
  SELECT vec_id AS position_id, label, CAST(unnest(range(64)) AS INTEGER) AS cell,
         unnest(CAST(embedding AS DOUBLE[])) AS x,
         unnest(list_reverse(CAST(embedding AS DOUBLE[]))) AS f,
         tanh(3 * CAST(embedding[1] AS DOUBLE)) AS value
  FROM embeddings),
lgl AS (SELECT *, (position_id * 31 + cell * 7) % 5 <> 0 AS legal FROM lg)"""


def _softmax(column: str, temperature: float, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, e / sum(e) OVER (PARTITION BY position_id) AS p FROM (
    SELECT *, exp(({column} - max({column}) OVER (PARTITION BY position_id)) / {temperature}) AS e FROM lgl))"""


LOSSES = f"""{LOGITS},
lsm AS (
  SELECT *, x - mx - ln(sum(exp(x - mx)) OVER (PARTITION BY position_id)) AS lx,
         f - mf - ln(sum(exp(f - mf)) OVER (PARTITION BY position_id)) AS lf
  FROM (SELECT *, max(x) OVER (PARTITION BY position_id) AS mx, max(f) OVER (PARTITION BY position_id) AS mf FROM lg)),
ls AS (
  SELECT position_id, position_id // 64 AS batch, position_id % 2 AS epoch, 1.0::DOUBLE / (any_value(label) + 1) AS weight,
         -sum(lx) FILTER (cell = label) AS policy_loss,
         pow(any_value(value) - (any_value(label) % 3 - 1), 2) AS value_loss,
         sum(exp(lx) * (lx - lf)) AS kl, -sum(exp(lx) * lf) AS fast_ce
  FROM lsm GROUP BY position_id)"""

MATCHES = """
mt AS (
  SELECT *, game_idx % 2 = 0 AS plays_black, CASE WHEN game_idx % 2 = 0 THEN outcome ELSE -outcome END AS seen
  FROM (
    SELECT o_custkey AS player,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS game_idx,
           CASE WHEN o_orderpriority LIKE '1-%' THEN NULL WHEN o_orderstatus = 'F' THEN 1
                WHEN o_orderstatus = 'O' THEN -1 ELSE 0 END AS outcome
    FROM orders))"""


def _elo(initial: float, opponent: float) -> str:
    return f"""WITH RECURSIVE {MATCHES},
walk AS (
  SELECT player, game_idx, {initial}::DOUBLE + 32 * (
           CASE seen WHEN 1 THEN 1.0::DOUBLE WHEN -1 THEN 0.0 ELSE 0.5 END
           - 1 / (1 + pow(10.0::DOUBLE, ({opponent} - {initial}) / 400.0))) AS rating
  FROM mt WHERE game_idx = 0
  UNION ALL
  SELECT m.player, m.game_idx, w.rating + 32 * (
           CASE m.seen WHEN 1 THEN 1.0::DOUBLE WHEN -1 THEN 0.0 ELSE 0.5 END
           - 1 / (1 + pow(10.0::DOUBLE, ({opponent} - w.rating) / 400.0)))
  FROM walk w JOIN mt m ON m.player = w.player AND m.game_idx = w.game_idx + 1)"""


_ELO_END = "SELECT player, round(arg_max(rating, game_idx), 6) AS elo, count(*) AS num_games FROM walk GROUP BY player"


# levels by walking from each node to the root, values by propagating each level to the one above
TREE = f"""WITH RECURSIVE part_nodes AS (
  SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // {TREE_ARITY} END AS parent,
         (p_size - 25) / 25.0::DOUBLE AS reward, p_retailprice % 100 / 100 AS leaf_value FROM part),
walk AS (
  SELECT node, node AS here, 0 AS steps FROM part_nodes
  UNION ALL SELECT node, (here - 1) // {TREE_ARITY}, steps + 1 FROM walk WHERE here > 0),
nodes AS (
  SELECT p.*, w.level FROM part_nodes p JOIN (
    SELECT node, CAST(max(steps) AS INTEGER) AS level FROM walk GROUP BY node) w USING (node)),
leaves AS (SELECT n.*, n.leaf_value AS value FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = n.node)),
backed AS (
  SELECT node, parent, level, reward, value, level AS turn FROM leaves WHERE level = (SELECT max(level) FROM nodes)
  UNION ALL
  SELECT * FROM (
    SELECT n.node, n.parent, n.level, n.reward,
           CASE WHEN n.level % 2 = 0 THEN max(b.value + b.reward) ELSE min(b.value - b.reward) END AS value, n.level AS turn
    FROM backed b JOIN nodes n ON b.parent = n.node WHERE b.turn = n.level + 1
    GROUP BY n.node, n.parent, n.level, n.reward
    UNION ALL
    SELECT l.node, l.parent, l.level, l.reward, l.value, l.level FROM leaves l
    WHERE l.level = (SELECT max(turn) - 1 FROM backed)))
SELECT node, level, round(value, 6) AS value FROM backed"""


def _top(column: str, k: int, where: str = "TRUE") -> str:
    return f"""SELECT position_id, cell, p, row_number() OVER (PARTITION BY position_id ORDER BY p DESC, cell) AS rank
  FROM {column} WHERE {where} QUALIFY rank <= {k}"""


AUGMENTED = f"""WITH {EXAMPLES}, {TIDS}, {_turned_views('seen')}
SELECT e.game_id, e.ply, t.transform_id, e.player,
       {_symmetry('t.transform_id', '(e.action // 9)', '(e.action % 9)', 9)} AS action, e.value,
       coalesce(v.own, '') AS own_cells, coalesce(v.opp, '') AS opp_cells
FROM exs e CROSS JOIN tids t LEFT JOIN tviews v
  ON v.game_id = e.game_id AND v.ply = e.ply AND v.transform_id = t.transform_id"""

def _stream_replay() -> str:
    """Quarter by quarter: a quarter's priority is the largest in the ring before it, errors taken in."""
    steps, pushed = [], "1.0::DOUBLE"
    for quarter in range(1, 4):
        steps.append(f"""t{quarter} AS (SELECT max(coalesce(error, {pushed})) AS top FROM (
  SELECT * FROM ev WHERE quarter < {quarter} ORDER BY seq DESC LIMIT 2500))""")
        pushed = f"CASE quarter WHEN 0 THEN 1.0::DOUBLE " + " ".join(
            f"WHEN {i} THEN (SELECT top FROM t{i})" for i in range(1, quarter + 1)) + " END"
    return f"""WITH ev AS (
  SELECT event_id AS seq, user_id, event_type, event_id * 4 // (SELECT count(*) FROM events) AS quarter,
         CASE WHEN event_type = 'click' THEN abs(value / 50) + 1e-6 END AS error FROM events),
{", ".join(steps)}
SELECT seq, user_id, event_type, round(coalesce(error, {pushed}), 6) AS priority FROM ev ORDER BY seq DESC LIMIT 2500"""


STREAM_REPLAY = _stream_replay()

SQL = {
    # records
    "strip_comments": f"WITH {RECORDS} SELECT game_id, part, body FROM stripped",
    "extract_properties": rf"""WITH {RECORDS},
kv AS (
  SELECT game_id, part, unnest(regexp_extract_all(body, '([A-Z]{{1,2}})\[([^\n]*?)\]', 1)) AS key,
         unnest(regexp_extract_all(body, '([A-Z]{{1,2}})\[([^\n]*?)\]', 2)) AS v,
         unnest(range(len(regexp_extract_all(body, '([A-Z]{{1,2}})\[([^\n]*?)\]', 1)))) AS pos FROM stripped)
SELECT game_id, part, key, CASE WHEN key IN ('AB', 'AW', 'B', 'W') THEN arg_min(v, pos)
       ELSE string_agg(v, '|' ORDER BY pos) END AS value
FROM kv GROUP BY game_id, part, key""",
    "game_header": f"""WITH {RECORDS}
SELECT game_id, part, board_size, result, black_player, white_player, game_date,
       CASE WHEN game_id % 7 = 0 THEN 6.5::DOUBLE ELSE komi END AS komi, outcome FROM rec JOIN gm USING (game_id)""",
    "extract_moves": f"WITH {RECORD_MOVES} SELECT game_id, part, ply, color, row, col FROM rmv",
    "extract_moves_strict": f"WITH {STRICT_MOVES} SELECT game_id, part, ply, color, row, col FROM rmv",
    "decode_coord": f"WITH {RECORD_MOVES} SELECT coord, count(*) AS times, any_value(row) AS row, any_value(col) AS col "
                    "FROM rmv GROUP BY coord",
    "cell_index": f"""WITH {MOVES}
SELECT game_id, ply, CASE WHEN k < 81 THEN k END AS cell, CASE WHEN k < 81 THEN row END AS row,
       CASE WHEN k < 81 THEN col END AS col FROM mv""",
    "filter_board_size": f"""WITH {RECORD_MOVES}
SELECT game_id, part, board_size, CAST(count(*) AS INTEGER) AS n_moves FROM rmv JOIN gm USING (game_id)
WHERE board_size = 19 GROUP BY ALL""",
    "move_sequence": f"""WITH {MOVES}
SELECT game_id, string_agg(row || ':' || col, ' ' ORDER BY ply) AS positions FROM mv GROUP BY game_id""",
    "parse_result": f"WITH {GAMES} SELECT game_id, result, outcome FROM gm",
    # replay and boards
    "replay_moves": f"""WITH {REPLAY}
SELECT game_id, ply, color, row, col, cell, in_bounds, accepted, n_before, player FROM rp""",
    "replay_records": f"""WITH {RECORD_REPLAY}
SELECT game_id, part, ply, cell, in_bounds, accepted, n_before, player FROM rp""",
    "board_at": f"WITH {BOARD} SELECT game_id, ply, player, own_cells, opp_cells FROM pos",
    "legal_moves": f"""WITH {BOARD},
free AS (
  SELECT r.game_id, r.ply, c.cell FROM rp r, (SELECT CAST(unnest(range(81)) AS INTEGER) AS cell) c
  ANTI JOIN seen s ON s.game_id = r.game_id AND s.ply = r.ply AND s.cell = c.cell)
SELECT game_id, ply, CAST(count(*) AS INTEGER) AS n_legal,
       string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS legal_cells FROM free GROUP BY game_id, ply""",
    "state_planes": f"""WITH {BOARD},
grid AS (
  SELECT r.game_id, r.ply, r.player, c.cell, s.color
  FROM rp r CROSS JOIN (SELECT CAST(unnest(range(81)) AS INTEGER) AS cell) c
  LEFT JOIN seen s ON s.game_id = r.game_id AND s.ply = r.ply AND s.cell = c.cell)
SELECT game_id, ply,
       string_agg(CASE WHEN color = player THEN '1' ELSE '0' END, '' ORDER BY cell) || repeat('0', 567)
       || string_agg(CASE WHEN color = -player THEN '1' ELSE '0' END, '' ORDER BY cell) || repeat('0', 567)
       || repeat(CAST(any_value(player) AS VARCHAR), 81)
       || string_agg(CASE WHEN color IS NULL THEN '1' ELSE '0' END, '' ORDER BY cell) || repeat('0', 81) AS planes
FROM grid GROUP BY game_id, ply""",
    "final_board": f"""WITH {GAME_END}
SELECT game_id, coalesce(black_cells, '') AS black_cells, coalesce(white_cells, '') AS white_cells FROM ended""",
    "stone_score": f"WITH {GAME_END} SELECT game_id, black, white FROM ended",
    "game_outcome": f"""WITH {GAME_END}
SELECT game_id, CAST(sign(black - white) AS INTEGER) AS outcome_now,
       CAST(CASE WHEN black + white >= 81 THEN sign(black - white) END AS INTEGER) AS outcome_full FROM ended""",
    "territory_diff": f"""WITH {REPLAY}
SELECT game_id, ply, player, round(coalesce(sum(CASE WHEN accepted THEN player ELSE 0 END) OVER (
         PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         / 81.0::DOUBLE * player, 6) AS territory_diff FROM rp""",
    "liberties": f"""WITH {BOARD},
steps AS (SELECT unnest([-1, 1, 0, 0]) AS dr, unnest([0, 0, -1, 1]) AS dc),
around AS (
  SELECT game_id, ply, cell, color, CAST((cell // 9 + dr) * 9 + cell % 9 + dc AS INTEGER) AS near FROM seen, steps
  WHERE cell // 9 + dr BETWEEN 0 AND 8 AND cell % 9 + dc BETWEEN 0 AND 8)
SELECT a.game_id, a.ply, a.cell, a.color, CAST(count(*) FILTER (s.cell IS NULL) AS INTEGER) AS liberties
FROM around a LEFT JOIN seen s ON s.game_id = a.game_id AND s.ply = a.ply AND s.cell = a.near
GROUP BY ALL""",
    "validate_moves": f"WITH {REPLAY} SELECT game_id, ply, row, col, accepted AS valid FROM rp",
    "render_board": f"""WITH {REPLAY},
ids AS (SELECT DISTINCT game_id FROM rp),
marks AS (
  SELECT i.game_id, c.cell, CASE s.player WHEN 1 THEN '● ' WHEN -1 THEN '○ ' ELSE '. ' END AS mark
  FROM ids i CROSS JOIN (SELECT unnest(range(81)) AS cell) c
  LEFT JOIN (SELECT * FROM rp WHERE accepted) s ON s.game_id = i.game_id AND s.cell = c.cell),
rws AS (SELECT game_id, cell // 9 AS r, string_agg(mark, '' ORDER BY cell) AS line FROM marks GROUP BY ALL)
SELECT game_id, '  0 1 2 3 4 5 6 7 8' || chr(10) || string_agg(r || ' ' || line, chr(10) ORDER BY r) AS picture
FROM rws GROUP BY game_id""",
    "game_summary": f"""WITH {GAME_END}, {GAMES}
SELECT game_id, black + white AS num_moves,
       CAST(CASE WHEN black + white >= 81 THEN sign(black - white) END AS INTEGER) AS stone_outcome, result, outcome
FROM ended JOIN gm USING (game_id)""",
    "recorded_versus_stones": f"""WITH {RECORD_REPLAY},
fin AS (
  SELECT game_id, part, CAST(count(*) AS INTEGER) AS n_moves,
         CAST(count(*) FILTER (accepted AND player = 1) AS INTEGER) AS black,
         CAST(count(*) FILTER (accepted AND player = -1) AS INTEGER) AS white FROM rp GROUP BY ALL)
SELECT game_id, part, result, outcome, n_moves, black, white, CAST(sign(black - white) AS INTEGER) AS stone_outcome,
       outcome = sign(black - white) AS agrees FROM fin JOIN gm USING (game_id)""",
    # examples and symmetry
    "examples": f"""WITH {EXAMPLES}
SELECT game_id, ply, player, action, value, accepted, own_cells, opp_cells FROM exs""",
    "examples_from_records": f"""WITH {RECORD_REPLAY}
SELECT game_id, part, ply, player, cell AS action, CAST(sign(outcome) * player AS DOUBLE) AS value
FROM rp JOIN gm USING (game_id) WHERE in_bounds""",
    "policy_target": f"""WITH {MOVES}
SELECT game_id, ply, CASE WHEN k < 81 THEN repeat('0', k) || '1' || repeat('0', 80 - k) END AS policy FROM mv""",
    "value_target": f"WITH {EXAMPLES} SELECT player, value, count(*) AS examples FROM exs GROUP BY ALL",
    "epoch_batches": f"""WITH {REPLAY},
drawn AS (
  SELECT e.epoch, game_id, ply,
         CAST('0x' || substr(md5(game_id || ':' || ply || ':' || (7 + e.epoch)), 1, 8) AS BIGINT) AS u
  FROM rp, (SELECT CAST(unnest(range(2)) AS INTEGER) AS epoch) e WHERE in_bounds),
placed AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY u, game_id, ply) - 1 AS pos FROM drawn)
SELECT epoch, pos // 256 AS batch, pos % 256 AS slot, game_id, ply FROM placed""",
    "symmetry_map": f"""WITH {MOVES}, {TIDS}
SELECT game_id, ply, k AS from_cell, transform_id, {_symmetry('transform_id', 'row', 'col', 9)} AS to_cell
FROM mv, tids WHERE k < 81""",
    "augment_examples": AUGMENTED,
    "augmented_examples": AUGMENTED,
    "transform_vector": f"""WITH {LOGITS}
SELECT position_id, CAST(position_id % 8 AS INTEGER) AS transform_id,
       {_symmetry('position_id % 8', '(cell // 8)', '(cell % 8)', 8)} AS cell, round(x, 6) AS logit FROM lg""",
    "transform_planes": f"""WITH {BOARD}, {TIDS}, {_turned_views('seen')}
SELECT r.game_id, r.ply, CAST(r.ply % 8 AS INTEGER) AS transform_id, 1539 AS n_values,
       coalesce(v.own, '') AS own_cells, coalesce(v.opp, '') AS opp_cells
FROM rp r LEFT JOIN tviews v ON v.game_id = r.game_id AND v.ply = r.ply AND v.transform_id = r.ply % 8""",
    # trajectories
    "transitions": f"WITH {TRANSITIONS} SELECT game_id, ply, player, action, next_ply, done FROM tr",
    "n_step_return": f"WITH {TRANSITIONS} SELECT game_id, ply, round(n_step, 6) AS n_step_return FROM nst",
    "rewards": f"WITH {TRANSITIONS} SELECT game_id, ply, done, round(reward, 6) AS reward FROM rw",
    "td_target": f"""WITH {TRANSITIONS},
td AS (SELECT *, reward + CASE WHEN done THEN 0 ELSE pow(0.99, 5) * next_value END AS target FROM rw)
SELECT game_id, ply, round(target, 6) AS td_target, round(abs(diff - target), 6) AS td_error FROM td""",
    "augment_transitions": f"""WITH {TRANSITIONS}, {TIDS},
stones AS (SELECT game_id, ply AS placed, action AS cell, player AS color FROM acc),
seen AS (
  SELECT r.game_id, r.ply, r.player, s.cell, s.color FROM acc r JOIN stones s
    ON r.game_id = s.game_id AND s.placed < r.ply), {_turned_views('seen')}
SELECT r.game_id, r.ply, t.transform_id,
       {_symmetry('t.transform_id', '(r.action // 9)', '(r.action % 9)', 9)} AS action,
       round(r.reward, 6) AS reward, r.next_ply, r.done,
       coalesce(v.own, '') AS own_cells, coalesce(nv.own, '') AS next_own_cells
FROM rw r CROSS JOIN tids t
LEFT JOIN tviews v ON v.game_id = r.game_id AND v.ply = r.ply AND v.transform_id = t.transform_id
LEFT JOIN tviews nv ON nv.game_id = r.game_id AND nv.ply = r.next_ply AND nv.transform_id = t.transform_id""",
    # replay table
    "replay_push": f"""WITH {REPLAY_ROWS}
SELECT seq, user_id, event_type, round(priority, 6) AS priority FROM rep
UNION ALL
SELECT (SELECT max(seq) FROM rep) + row_number() OVER (ORDER BY user_id, seq), user_id, event_type,
       round((SELECT max(priority) FROM rep), 6)
FROM rep WHERE event_type = 'click'""",
    "replay_evict": f"""WITH {REPLAY_ROWS}
SELECT seq, user_id, event_type, round(priority, 6) AS priority FROM rep ORDER BY seq DESC LIMIT 2500""",
    "replay_push_evict": f"""WITH {REPLAY_ROWS},
pushed AS (
  SELECT seq, user_id, event_type, priority FROM rep
  UNION ALL
  SELECT (SELECT max(seq) FROM rep) + row_number() OVER (ORDER BY user_id, seq), user_id, event_type, (SELECT max(priority) FROM rep)
  FROM rep WHERE event_type = 'click')
SELECT seq, user_id, event_type, round(priority, 6) AS priority FROM pushed ORDER BY seq DESC LIMIT 2500""",
    "transition_replay": f"""WITH {TRANSITIONS}, {TIDS},
queue AS (
  SELECT row_number() OVER (ORDER BY r.game_id, r.ply, t.transform_id) - 1 AS seq, r.game_id, r.ply, t.transform_id,
         {_symmetry('t.transform_id', '(r.action // 9)', '(r.action % 9)', 9)} AS action, r.reward, r.done
  FROM rw r CROSS JOIN tids t),
ring AS (SELECT * FROM queue ORDER BY seq DESC LIMIT 2500),
drawn AS (SELECT *, ('0x' || substr(md5(seq || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ring)
SELECT seq, game_id, ply, transform_id, action, round(reward, 6) AS reward, done, 1.0::DOUBLE AS priority
FROM drawn ORDER BY -ln(1 - u), seq LIMIT 64""",
    "sampling_probs": f"WITH {REPLAY_ROWS} SELECT seq, round(prob * 1000, 6) AS prob_per_mille FROM pr",
    "replay_sample": f"""WITH {REPLAY_ROWS}
SELECT seq, round(priority, 6) AS priority FROM un ORDER BY -ln(1 - u) / w, seq LIMIT 64""",
    "importance_weights": f"""WITH {REPLAY_ROWS},
drawn AS (SELECT *, pow((SELECT count(*) FROM rep) * prob, -0.4) AS raw FROM un ORDER BY -ln(1 - u) / w, seq LIMIT 64)
SELECT seq, round(raw / (SELECT max(raw) FROM drawn), 6) AS weight FROM drawn""",
    "update_priorities": """SELECT event_id AS seq, round(CASE WHEN event_type = 'click' THEN abs(value / 50) + 1e-6
       ELSE value / 100 + 1e-6 END, 6) AS priority FROM events""",
    "sample_uniform": f"WITH {REPLAY_ROWS} SELECT seq, 1.0::DOUBLE AS weight FROM un ORDER BY u, seq LIMIT 64",
    # prediction tables
    "softmax": f"WITH {LOGITS}, {_softmax('x', 0.5, 'sm')} SELECT position_id, cell, round(p, 6) AS prob FROM sm",
    "masked_policy": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')}
SELECT position_id, cell, round(CASE WHEN legal THEN p ELSE 0 END
       / sum(CASE WHEN legal THEN p ELSE 0 END) OVER (PARTITION BY position_id), 6) AS prob FROM sm""",
    "greedy_move": f"""WITH {LOGITS}
SELECT position_id, cell AS move FROM lgl WHERE legal
QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY x DESC, cell) = 1""",
    "sample_move": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')},
cdf AS (
  SELECT position_id, cell, sum(p) OVER (PARTITION BY position_id ORDER BY cell)
         / sum(p) OVER (PARTITION BY position_id) AS cum FROM sm WHERE legal)
SELECT position_id, coalesce(min(cell) FILTER (
         cum > CAST('0x' || substr(md5(position_id || ':7'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE), max(cell)) AS move
FROM cdf GROUP BY position_id""",
    "candidate_moves": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')}
SELECT position_id, CAST(rank AS INTEGER) AS rank, cell, round(p, 6) AS prob FROM ({_top('sm', 5, 'legal')})""",
    "suggest_moves": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')}
SELECT position_id, CAST(rank AS INTEGER) AS rank, cell, round(p, 6) AS prob,
       CAST(cell // 8 AS INTEGER) AS row, CAST(cell % 8 AS INTEGER) AS col FROM ({_top('sm', 5)})""",
    "evaluate_positions": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')}
SELECT position_id, cell AS best_move, round(p, 6) AS best_prob, round(value, 6) AS value FROM sm
QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY p DESC, cell) = 1""",
    "blend_select": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')},
tp AS ({_top('sm', 5)}),
tried AS (
  SELECT tp.position_id, tp.cell, tp.rank, 0.7 * p + 0.3 * tanh(f) AS score
  FROM tp JOIN lgl USING (position_id, cell) WHERE legal
  QUALIFY row_number() OVER (PARTITION BY tp.position_id ORDER BY score DESC, rank) = 1),
firsts AS (SELECT position_id, min(cell) FILTER (legal) AS cell FROM lgl GROUP BY position_id)
SELECT f.position_id, coalesce(t.cell, f.cell, 0) AS move, round(t.score, 6) AS score
FROM firsts f LEFT JOIN tried t USING (position_id)""",
    "policy_distribution": f"WITH {LOGITS}, {_softmax('x', 2.0, 'sm')} SELECT position_id, cell, round(p, 6) AS prob FROM sm",
    "compare_heads": f"""WITH {LOGITS}, {_softmax('x', 1.0, 'sm')}, {_softmax('f', 1.0, 'fm')},
tops AS (SELECT 'policy' AS head, * FROM ({_top('sm', 5)}) UNION ALL SELECT 'fast_policy', * FROM ({_top('fm', 5)}))
SELECT position_id, head, CAST(rank AS INTEGER) AS rank, cell, round(p, 6) AS prob,
       CAST(cell // 8 AS INTEGER) AS row, CAST(cell % 8 AS INTEGER) AS col FROM tops""",
    "expand_positions": f"""WITH {BOARD},
free AS (
  SELECT r.game_id, r.ply, r.player, c.cell FROM rp r, (SELECT CAST(unnest(range(81)) AS INTEGER) AS cell) c
  ANTI JOIN seen s ON s.game_id = r.game_id AND s.ply = r.ply AND s.cell = c.cell),
kids AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY game_id, ply ORDER BY cell) <= 3),
after AS (
  SELECT k.game_id, k.ply, k.cell AS child_cell, s.cell, s.color FROM kids k JOIN seen s USING (game_id, ply)
  UNION ALL SELECT game_id, ply, cell, cell, player FROM kids)
SELECT k.game_id, k.ply, k.cell AS child_cell, -k.player AS player,
       coalesce(string_agg(CAST(a.cell AS VARCHAR), ',' ORDER BY a.cell) FILTER (a.color = -k.player), '') AS own_cells,
       coalesce(string_agg(CAST(a.cell AS VARCHAR), ',' ORDER BY a.cell) FILTER (a.color = k.player), '') AS opp_cells
FROM kids k JOIN after a ON a.game_id = k.game_id AND a.ply = k.ply AND a.child_cell = k.cell GROUP BY ALL""",
    "backup_tree": TREE,
    # losses and schedules
    "policy_cross_entropy": f"WITH {LOSSES} SELECT position_id, round(policy_loss, 6) AS policy_loss FROM ls",
    "value_mse": f"WITH {LOSSES} SELECT position_id, round(value_loss, 6) AS value_loss FROM ls",
    "fast_kl": f"WITH {LOSSES} SELECT batch, round(avg(kl), 6) AS fast_loss FROM ls GROUP BY batch",
    "fast_cross_entropy": f"WITH {LOSSES} SELECT position_id, round(fast_ce, 6) AS fast_loss FROM ls",
    "total_loss": f"""WITH {LOSSES}
SELECT epoch, batch, round(avg(policy_loss * weight), 6) AS policy_loss, round(avg(value_loss * weight), 6) AS value_loss,
       round(avg(fast_ce * weight), 6) AS fast_loss,
       round(avg(policy_loss * weight) + avg(value_loss * weight) + 0.5 * avg(fast_ce * weight), 6) AS total_loss
FROM ls GROUP BY epoch, batch""",
    "epoch_loss": f"""WITH {LOSSES},
bl AS (SELECT epoch, batch, avg(policy_loss) + avg(value_loss) + 0.5 * avg(kl) AS total FROM ls GROUP BY epoch, batch)
SELECT epoch, round(avg(total), 6) AS loss, count(*) AS batches FROM bl GROUP BY ROLLUP (epoch)""",
    "cosine_lr": """SELECT event_id AS step,
       round((1e-5 + (1e-3 - 1e-5) * (1 + cos(pi() * event_id / 5000)) / 2) * 1000, 6) AS lr_e3 FROM events""",
    "temperature": """SELECT event_id AS step, round(greatest(0.1::DOUBLE, pow(0.9999::DOUBLE, event_id)), 6) AS temperature
FROM events""",
    # ratings
    "tally": f"""WITH {MATCHES}
SELECT player, count(*) FILTER (seen = 1) AS wins, count(*) FILTER (seen = -1) AS losses,
       count(*) FILTER (coalesce(seen, 0) = 0) AS draws, count(*) AS num_games FROM mt GROUP BY player""",
    "win_rate": f"""WITH {MATCHES}
SELECT player, count(*) AS num_games, round(count(*) FILTER (seen = 1) / count(*)::DOUBLE, 6) AS win_rate
FROM mt GROUP BY player""",
    "elo": f"{_elo(1000, 1000)} {_ELO_END}",
    "elo_fixed_1500": f"{_elo(1500, 1500)} {_ELO_END}",
    "elo_history": f"""{_elo(1000, 1000)}
SELECT player, game_idx + 1 AS games, round(rating, 6) AS elo FROM walk WHERE (game_idx + 1) % 10 = 0""",
    "tally_history": f"""WITH {MATCHES}
SELECT player, game_idx + 1 AS games, CAST(count(*) FILTER (seen = 1) OVER w AS BIGINT) AS wins,
       CAST(count(*) FILTER (seen = -1) OVER w AS BIGINT) AS losses,
       CAST(count(*) FILTER (coalesce(seen, 0) = 0) OVER w AS BIGINT) AS draws
FROM mt WINDOW w AS (PARTITION BY player ORDER BY game_idx) QUALIFY (game_idx + 1) % 10 = 0""",
    "elo_tally": f"""WITH {MATCHES}
SELECT player, count(*) FILTER (seen = 1) AS wins, count(*) FILTER (seen = -1) AS losses,
       count(*) FILTER (seen = 0) AS draws, count(*) AS num_games FROM mt GROUP BY player""",
    "head_to_head": """SELECT black, white, count(*) FILTER (o = 1) AS black_wins, count(*) FILTER (o = -1) AS white_wins,
       count(*) FILTER (coalesce(o, 0) = 0) AS draws, count(*) AS num_games
FROM (SELECT o_custkey % 100 AS black, o_orderkey % 50 AS white,
             CASE WHEN o_orderpriority LIKE '1-%' THEN NULL WHEN o_orderstatus = 'F' THEN 1
                  WHEN o_orderstatus = 'O' THEN -1 ELSE 0 END AS o FROM orders) GROUP BY black, white""",
    "latency_summary": """SELECT l_returnflag AS run, count(*) AS num_positions, round(avg(l_quantity / 1000), 6) AS avg_time,
       round(min(l_quantity / 1000), 6) AS min_time, round(max(l_quantity / 1000), 6) AS max_time,
       round(1 / avg(l_quantity / 1000), 6) AS positions_per_second FROM lineitem GROUP BY l_returnflag""",
    # sources and sinks
    "read_game_dir": f"WITH {LOADED} SELECT * EXCLUDE (path) FROM loaded WHERE board_size = 9",
    "read_game_file": f"WITH {LOADED} SELECT * EXCLUDE (path) FROM loaded",
    "read_game_archive": f"WITH {LOADED} SELECT * EXCLUDE (path) FROM loaded",
    "read_game_archives": f"WITH {LOADED} SELECT * EXCLUDE (path) FROM loaded",
    "limit_games": f"WITH {LOADED} SELECT * EXCLUDE (path) FROM loaded WHERE board_size = 9 ORDER BY path LIMIT 50",
    "write_and_read_games": f"""WITH {RECORD_MOVES}
SELECT game_id, part, board_size, outcome, string_agg(CAST(row * 19 + col AS VARCHAR), ',' ORDER BY ply) AS cells
FROM rmv JOIN gm USING (game_id) GROUP BY ALL""",
    # models
    "score_with_function": f"""WITH {BOARD},
counted AS (
  SELECT r.game_id, r.ply, count(cell) FILTER (s.color = r.player) AS own,
         count(cell) FILTER (s.color <> r.player) AS opp
  FROM (SELECT game_id, ply, player FROM rp) r LEFT JOIN (SELECT game_id, ply, cell, color FROM seen) s USING (game_id, ply)
  GROUP BY r.game_id, r.ply),
firsts AS (
  SELECT r.game_id, r.ply, min(c.cell) AS best_move
  FROM rp r, (SELECT CAST(unnest(range(81)) AS INTEGER) AS cell) c
  ANTI JOIN seen s ON s.game_id = r.game_id AND s.ply = r.ply AND s.cell = c.cell GROUP BY r.game_id, r.ply)
SELECT game_id, ply, round(tanh(own - opp), 6) AS value, best_move,
       round(CAST(81 - own - opp - 0.5 * own - opp AS DOUBLE), 6) AS logit_sum FROM counted JOIN firsts USING (game_id, ply)""",
    # streams
    "stream_games": f"WITH {LOADED} SELECT * EXCLUDE (path) FROM loaded",
    "stream_elo": f"""{_elo(1000, 1000)}
SELECT player, round(arg_max(rating, w.game_idx), 6) AS elo, count(*) FILTER (seen = 1) AS wins,
       count(*) FILTER (seen = -1) AS losses, count(*) FILTER (coalesce(seen, 0) = 0) AS draws, count(*) AS num_games
FROM walk w JOIN mt USING (player, game_idx) GROUP BY player""",
    "stream_replay": STREAM_REPLAY,
    # models: what is known of a fit without making it
    "pretrain": f"""WITH {EXAMPLES}
SELECT 3::BIGINT AS epochs, count(*) AS total_examples, TRUE AS policy_learns, TRUE AS fast_learns, TRUE AS value_learns,
       TRUE AS adds_up FROM exs""",
    "write_and_read_run": f"""WITH {EXAMPLES},
known AS (
  SELECT unnest(['phase', 'epochs', 'total_examples', 'pretrain_loss', 'policy_loss', 'value_loss', 'fast_loss']) AS key,
         unnest(['pretrain', '2', CAST((SELECT count(*) FROM exs) AS VARCHAR), 'number', 'number', 'number', 'number']) AS value)
SELECT key, value, CAST(3 AS INTEGER) AS stages FROM known""",
    "score_with_pipeline": f"""WITH {EXAMPLES}
SELECT game_id, ply, TRUE AS on_board, TRUE AS fast_on_board, TRUE AS is_number FROM exs""",
}
