"""The views of ``parley.sources.views`` in DuckDB SQL, written apart from them."""


def norm(x: str, glosses: bool = True) -> str:
    t = f"regexp_replace(nfc_normalize(coalesce({x}, '')), '(?s)\\[.*?\\]|<.*?>', ' ', 'g')"
    if glosses:
        t = f"regexp_replace({t}, '(?s)\\(.*?\\)', ' ', 'g')"
    t = f"lower(regexp_replace({t}, '[\\x{{200b}}-\\x{{200f}}\\x{{feff}}]', '', 'g'))"
    return f"trim(regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Z}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def rate(d: str, n: str, m: str) -> str:
    return f"CASE WHEN {n} = 0 AND {m} = 0 THEN 0.0 WHEN {n} = 0 OR {m} = 0 THEN 1.0 ELSE CAST({d} AS DOUBLE) / {n} END"


WRONG = "CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'system' ELSE 'user' END"


def label(x: str) -> str:
    return f"CASE {x} WHEN 'user' THEN 'Speaker 0' WHEN 'assistant' THEN 'Speaker 1' ELSE 'Speaker 2' END"


def words_distance(r: str, h: str) -> str:
    """Levenshtein over two lists by rows of the table; both are lists of whole numbers."""
    inner = f"list_reduce(list_prepend([prev[1] + 1], list_transform(range(1, len({h}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, prev[j[1] + 1] + 1, prev[j[1]] + CASE WHEN {h}[j[1]] = c[1] THEN 0 ELSE 1 END)))"
    return f"list_reduce(list_prepend(range(0, len({h}) + 1), list_transform({r}, lambda w: [w])), lambda prev, c: {inner})[len({h}) + 1]"


BUCKET = "CASE WHEN duration_ms < 70000 THEN '<70s' WHEN duration_ms < 180000 THEN '70s-180s' WHEN duration_ms < 300000 THEN '180s-300s' ELSE '300s-600s' END"
PCT = "CASE WHEN duration_ms > 0 THEN 100.0 * overlap_ms / duration_ms ELSE 0.0 END"
TIER = f"CASE WHEN {PCT} < 16 THEN 'moderate_12_16_pct' WHEN {PCT} < 20 THEN 'high_16_20_pct' ELSE 'extreme_over_20_pct' END"



def best_of(name: str, cells: str) -> str:
    """name(sample_id, strategy, best, total): the largest sum of v over one-to-one pairs of at most three labels a side, by enumeration."""
    return f"""{name}_l AS (SELECT sample_id, strategy, list_sort(list_distinct(list(ref_speaker))) AS rs, list_sort(list_distinct(list(hyp_speaker))) AS hs, sum(v) AS total FROM {cells} GROUP BY ALL),
{name}_p AS (SELECT c.sample_id, c.strategy, q, sum(CASE WHEN q[list_position(rs, ref_speaker)] = list_position(hs, hyp_speaker) THEN v ELSE 0 END) AS hit, any_value(total) AS total
  FROM {cells} c JOIN {name}_l USING (sample_id, strategy), (SELECT unnest([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]) AS q) GROUP BY ALL),
{name} AS (SELECT sample_id, strategy, CAST(max(hit) AS BIGINT) AS best, CAST(max(total) AS BIGINT) AS total FROM {name}_p GROUP BY ALL)"""


#: Every hypothesis here is its reference with words left out, or the other way round, so the alignment that prefers
#: matches from the end is the embedding of the shorter side in the longer one that takes the last place it can.
MATCHED = f"""
ref_side AS (SELECT sample_id, flatten(list(words ORDER BY turn_idx)) AS rw, flatten(list(list_transform(words, lambda x: speaker) ORDER BY turn_idx)) AS rb FROM turns GROUP BY ALL),
hyp_side AS (SELECT sample_id, strategy, flatten(list(words ORDER BY turn_idx)) AS hw, flatten(list(list_transform(words, lambda x: speaker) ORDER BY turn_idx)) AS hb FROM hyps GROUP BY ALL),
both_sides AS (SELECT *, len(hw) > len(rw) AS more, CASE WHEN len(hw) > len(rw) THEN hw ELSE rw END AS big, CASE WHEN len(hw) > len(rw) THEN rw ELSE hw END AS small FROM hyp_side JOIN ref_side USING (sample_id)),
big_places AS (SELECT sample_id, strategy, w, list(i ORDER BY i) AS pl FROM (SELECT sample_id, strategy, unnest(big) AS w, generate_subscripts(big, 1) AS i FROM both_sides) GROUP BY ALL),
small_places AS (SELECT sample_id, strategy, list(pl ORDER BY j DESC) AS pls FROM (SELECT sample_id, strategy, unnest(small) AS w, generate_subscripts(small, 1) AS j FROM both_sides) JOIN big_places USING (sample_id, strategy, w) GROUP BY ALL),
embedded AS (SELECT b.*, list_reverse(list_reduce(list_prepend([len(big) + 1], pls), lambda s, e: list_append(s, list_filter(e, lambda i: i < s[len(s)])[-1]))[2:]) AS pl FROM both_sides b JOIN small_places USING (sample_id, strategy)),
aligned AS (SELECT sample_id, strategy, CASE WHEN more THEN rb[j] ELSE rb[i] END AS ref_speaker, CASE WHEN more THEN hb[i] ELSE hb[j] END AS hyp_speaker
  FROM (SELECT sample_id, strategy, more, rb, hb, unnest(pl) AS i, generate_subscripts(pl, 1) AS j FROM embedded)),
aligned_cells AS (SELECT sample_id, strategy, ref_speaker, hyp_speaker, count(*) AS v FROM aligned GROUP BY ALL),
{best_of("saa_best", "aligned_cells")}"""

WIDE = 120
_ALL = f"{(1 << WIDE) - 1}::HUGEINT"
_FEWER, _MORE = "CAST(a[1] < 0 AS HUGEINT)", "CAST(a[1] > 0 AS HUGEINT)"
#: One block of rows of one column of an edit table, as bits: a is [step into the block, ...], q is [same, up, down, last row].
_BLOCK = f"""list_transform([xor((((q[1] | {_FEWER}) & q[2]) + q[2]), q[2]) | q[1] | {_FEWER}], lambda across:
  list_transform([[q[3] | xor({_ALL}, {_ALL} & (across | q[2])), q[2] & across]], lambda d:
    list_concat(list_prepend(((d[1] >> q[4]) & 1) - ((d[2] >> q[4]) & 1), a[2:]),
      [((d[2] << 1) & {_ALL}) | {_FEWER} | xor({_ALL}, q[1] | q[3] | ((d[1] << 1) & {_ALL}) | {_MORE}), (((d[1] << 1) & {_ALL}) | {_MORE}) & (q[1] | q[3])]))[1])[1]"""
_COLUMN = f"""list_transform([list_reduce(list_prepend([1::HUGEINT], list_transform(range(1, len(e) + 1), lambda b: [e[b], s[2 * b], s[2 * b + 1], CASE WHEN b = len(e) THEN last ELSE {WIDE - 1} END])), lambda a, q: {_BLOCK})], lambda r: list_prepend(s[1] + r[1], r[2:]))[1]"""
_WALK = f"list_reduce(list_prepend(list_prepend(len(x)::HUGEINT, flatten(list_transform(cols[1], lambda b: [{_ALL}, 0::HUGEINT]))), cols), lambda s, e: {_COLUMN})[1]"
#: Word edit distance of every two speakers' documents of a sample, by bit vectors; eight branches only to use eight threads.
COSTS = f"""
ref_docs AS (SELECT sample_id, speaker, flatten(list(words ORDER BY turn_idx)) AS doc FROM turns WHERE n_words > 0 GROUP BY ALL),
hyp_docs AS (SELECT sample_id, strategy, speaker, flatten(list(words ORDER BY turn_idx)) AS doc FROM hyps WHERE len(words) > 0 GROUP BY ALL),
doc_pairs AS (SELECT row_number() OVER () AS p, h.sample_id, strategy, r.speaker AS ref_speaker, h.speaker AS hyp_speaker, len(r.doc) AS n, len(h.doc) AS m,
  CASE WHEN len(r.doc) >= len(h.doc) THEN r.doc ELSE h.doc END AS x, CASE WHEN len(r.doc) >= len(h.doc) THEN h.doc ELSE r.doc END AS y FROM hyp_docs h JOIN ref_docs r USING (sample_id)),
row_words AS (SELECT p, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS i FROM doc_pairs),
column_words AS (SELECT p, unnest(y) AS w, generate_subscripts(y, 1) AS j FROM doc_pairs),
row_bits AS (SELECT p, i // {WIDE} AS b, w, CAST(sum(1::HUGEINT << (i % {WIDE})::INT) AS HUGEINT) AS same FROM row_words GROUP BY ALL),
row_blocks AS (SELECT p, unnest(range(0, (len(x) + {WIDE - 1}) // {WIDE})) AS b FROM doc_pairs),
column_bits AS (SELECT c.p, j, list(coalesce(same, 0::HUGEINT) ORDER BY k.b) AS e FROM row_blocks k JOIN column_words c USING (p) LEFT JOIN row_bits r ON r.p = k.p AND r.b = k.b AND r.w = c.w GROUP BY c.p, j),
columns_of AS (SELECT p, list(e ORDER BY j) AS cols FROM column_bits GROUP BY p),
tables_of AS (SELECT d.*, cols, ((len(x) - 1) % {WIDE})::HUGEINT AS last FROM doc_pairs d JOIN columns_of USING (p)),
costs AS MATERIALIZED ({" UNION ALL ".join(f"SELECT sample_id, strategy, ref_speaker, hyp_speaker, n, m, CAST({_WALK} AS BIGINT) AS cost FROM tables_of WHERE p % 8 = {k}" for k in range(8))}),
saved AS (SELECT sample_id, strategy, ref_speaker, hyp_speaker, n + m - cost AS v FROM costs),
{best_of("cost_best", "saved")}"""

VIEWS = f"""
t0 AS (
  SELECT conv_id AS sample_id, CAST(turn AS INTEGER) AS turn_idx, role AS speaker, text,
         list_filter(string_split({norm("text")}, ' '), lambda x: x <> '') AS words FROM conversations),
t1 AS (
  SELECT *, CAST(len(words) AS INTEGER) AS n_words, lag(speaker) OVER w AS prev, lag(len(words)) OVER w AS prev_n
  FROM t0 WINDOW w AS (PARTITION BY sample_id ORDER BY turn_idx)),
t2 AS (SELECT *, CASE WHEN prev <> speaker THEN 160 * least(n_words, prev_n) ELSE 0 END AS early FROM t1),
t3 AS (
  SELECT sample_id, turn_idx, speaker, text, words, n_words,
         CAST(coalesce(sum(n_words) OVER (PARTITION BY sample_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 400
              - sum(early) OVER (PARTITION BY sample_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS start_ms FROM t2),
turns AS (SELECT *, start_ms + n_words * 400 AS end_ms FROM t3),
s1 AS (SELECT *, greatest(lag(end_ms) OVER (PARTITION BY sample_id ORDER BY turn_idx) - start_ms, 0) AS o FROM turns),
samples AS (
  SELECT sample_id, max(end_ms) AS duration_ms, CAST(count(DISTINCT speaker) AS INTEGER) AS num_speakers, CAST(count(*) AS INTEGER) AS num_turns,
         CAST(sum(n_words) AS BIGINT) AS n_words, CAST(coalesce(sum(o), 0) AS BIGINT) AS overlap_ms FROM s1 GROUP BY sample_id),
h0 AS (
  SELECT 'baseline' AS strategy, sample_id, turn_idx, CASE WHEN (3 * sample_id + turn_idx) % 5 = 0 THEN {WRONG} ELSE speaker END AS role,
         CASE WHEN sample_id % 17 = 0 THEN words || words || words || words
              ELSE list_filter(words, lambda w, i: (i - 1 + turn_idx) % 7 <> 6) END AS words FROM turns
  UNION ALL
  SELECT 'adaptive', sample_id, turn_idx, CASE WHEN (sample_id + turn_idx) % 9 = 0 THEN {WRONG} ELSE speaker END,
         list_filter(words, lambda w, i: (i - 1 + sample_id) % 13 <> 12) FROM turns
  UNION ALL
  SELECT 'flips', sample_id, turn_idx, CASE WHEN (sample_id + 2 * turn_idx) % 4 = 0 THEN {WRONG} ELSE speaker END, words FROM turns
  UNION ALL
  SELECT 'labels', sample_id, turn_idx, {WRONG}, words FROM turns),
hyps AS (SELECT *, {label("role")} AS speaker FROM h0),
{MATCHED},
{COSTS},
k1 AS (
  SELECT sample_id, strategy, CAST(len(rw) AS BIGINT) AS n, CAST(len(hw) AS BIGINT) AS m, length(array_to_string(rw, ' ')) AS cn, length(array_to_string(hw, ' ')) AS cm FROM both_sides),
k2 AS (
  SELECT k1.sample_id, k1.strategy, {rate("abs(n - m)", "n", "m")} AS wer, {rate("abs(cn - cm)", "cn", "cm")} AS cer,
         CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE CAST(s.best AS DOUBLE) / s.total END AS saa,
         {rate("(n + m - c.best)", "n", "m")} AS cpwer
  FROM k1 LEFT JOIN saa_best s USING (sample_id, strategy) LEFT JOIN cost_best c USING (sample_id, strategy)),
scores AS (
  SELECT k2.sample_id, strategy, duration_ms, num_speakers, num_turns, overlap_ms, wer, cer, saa, cpwer, greatest(0.0, cpwer - wer) AS gap,
         CAST(CASE strategy WHEN 'baseline' THEN 2000 + duration_ms // 20 WHEN 'adaptive' THEN 1500 + duration_ms // 25 ELSE 1000 + duration_ms // 40 END AS BIGINT) AS latency_ms
  FROM k2 JOIN samples USING (sample_id)),
segs AS (
  SELECT user_id AS sample_id, event_type AS speaker, event_id AS pos, epoch_us(ts) // 1000 AS start_ms,
         epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) AS end_ms FROM events)
"""


def sweep(source: str) -> str:
    """Overlap by counting, at each elementary interval, the distinct speakers with an open segment."""
    return f"""
    e AS (SELECT sample_id, speaker, start_ms AS t, 1 AS d FROM {source} UNION ALL SELECT sample_id, speaker, end_ms, -1 FROM {source}),
    e1 AS (SELECT sample_id, speaker, t, sum(d) AS d FROM e GROUP BY ALL),
    e2 AS (SELECT *, sum(d) OVER (PARTITION BY sample_id, speaker ORDER BY t) > 0 AS on_ FROM e1),
    e3 AS (SELECT sample_id, t, CAST(on_ AS INTEGER) - coalesce(CAST(lag(on_) OVER (PARTITION BY sample_id, speaker ORDER BY t) AS INTEGER), 0) AS step FROM e2),
    e4 AS (SELECT sample_id, t, sum(step) AS step FROM e3 GROUP BY ALL),
    e5 AS (SELECT sample_id, t, sum(step) OVER w AS live, lead(t) OVER w AS nx FROM e4 WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
    ov AS (SELECT sample_id, CAST(sum(CASE WHEN live >= 2 THEN nx - t ELSE 0 END) AS BIGINT) AS overlap FROM e5 GROUP BY sample_id)"""
