"""DuckDB SQL for the registered queries, built from shared WITH parts."""

from __future__ import annotations

import textwrap

from stratalens.functions import stem
from stratalens.operators.rows import Permutation

N_LAYERS = 24
TOKEN = r"[^\p{L}\p{N}]+"
# The code points that count as blank, and the headings of an unwanted suffix.
BLANKS = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)
HEADINGS = "keywords|tags|title|description|categories|question|answer"
BLANK_SQL = "concat(" + ", ".join(f"chr({c})" for c in BLANKS) + ")"


def with_parts(*parts: str, select: str, recursive: bool = False) -> str:
    body = ",\n".join(textwrap.dedent(part).strip() for part in parts)
    return f"WITH {'RECURSIVE ' * recursive}{body}\n{textwrap.dedent(select).strip()}"


def quoted(sql: str) -> str:
    """A text in the notation of a list: double quotes only around a text with single and no double ones."""
    body = f"replace({sql}, chr(92), chr(92) || chr(92))"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        body = f"replace({body}, chr({code}), chr(92) || '{letter}')"
    single, double = f"contains({sql}, chr(39))", f"contains({sql}, chr(34))"
    return f"""CASE WHEN {single} AND NOT {double} THEN concat(chr(34), {body}, chr(34))
              ELSE concat(chr(39), replace({body}, chr(39), chr(92) || chr(39)), chr(39)) END"""


def strip(sql: str) -> str:
    return f"trim({sql}, {BLANK_SQL})"


# --- layer similarity ---------------------------------------------------------------------------

STATES = """
h AS (SELECT cast(floor(vec_id / 25) AS bigint) s, cast(vec_id % 25 AS int) l, cast(embedding AS double[]) v
      FROM embeddings WHERE vec_id % 25 > 0)"""
PAIRS = """
d AS (SELECT a.s, b.l - a.l n, a.l block_start,
        acos(greatest(-1, least(1, list_inner_product(a.v, b.v)
          / greatest(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 1e-8)))) / pi() x
      FROM h a JOIN h b ON a.s = b.s AND a.l < b.l)"""
DIST = """
dist AS (SELECT n, block_start, block_start + n block_end, avg(x) average_distance FROM d GROUP BY n, block_start)"""
BEST = """
best AS (SELECT n, block_start, block_end, average_distance FROM
          (SELECT *, row_number() OVER (PARTITION BY n ORDER BY average_distance, block_start) rn FROM dist) WHERE rn = 1)"""
LAYERED = (STATES, PAIRS, DIST)


def matrix(row: str) -> str:
    cells = ", ".join(f"round(max(CASE WHEN n = {n} THEN average_distance END), 6) AS n_{n}" for n in range(1, N_LAYERS))
    return with_parts(*LAYERED, select=f"SELECT cast({row} AS int) layer, {cells} FROM dist GROUP BY 1")


def letter_states() -> str:
    counts = ", ".join(
        f"length(text) - length(replace(text, '{c}', '')) + l.l * {j + 1}" for j, c in enumerate("aeinrstu")
    )
    return f"""
    h AS (SELECT doc_id s, cast(l.l + 1 AS int) l, cast([{counts}] AS double[]) v FROM documents, range(4) l(l))"""


# --- items, answers, instructions ---------------------------------------------------------------

ITEMS = """
items AS (SELECT o_orderkey item_id, concat('Which part of order ', o_orderkey, ' costs most?') question,
            list(cast(l_partkey AS varchar) ORDER BY l_linenumber, l_partkey, l_extendedprice) choices,
            cast(list_position(list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice),
              max(l_extendedprice)) - 1 AS int) answer
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
RESPONSES = """
responses AS (SELECT event_type run_id, event_id item_id, concat('Question ', event_id, chr(10), CASE event_type
         WHEN 'view' THEN concat('Answer: ', chr(cast(65 + event_id % 4 AS int)))
         WHEN 'click' THEN 'Answer:'
         WHEN 'signup' THEN 'no answer here'
         WHEN 'error' THEN concat('Note: ', chr(cast(65 + user_id % 4 AS int)), ': later')
         ELSE concat('Answer:   ', chr(cast(65 + event_id % 3 AS int)), ' and more  ') END) response,
       cast(user_id % 4 AS int) truth FROM events)"""
PARSED = f"""
parsed AS (SELECT *, unicode(nullif(substr({strip("split_part(list_extract(string_split(" + strip("response") + ", chr(10)), -1), ':', 2)")}, 1, 1), '')) code
           FROM responses)"""
ANSWERS = (RESPONSES, PARSED)
INSTRUCTIONS = """
sys AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) text FROM conversations
        WHERE role = 'system' GROUP BY conv_id),
instructions AS (SELECT a.conv_id, a.turn, a.text instruction, coalesce(s.text, '') context, b.text response
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  LEFT JOIN sys s ON s.conv_id = a.conv_id WHERE a.role = 'user' AND b.role = 'assistant')"""


def options(mark: str) -> str:
    return f"array_to_string(list_transform(choices, lambda c, i: concat({mark}, '. ', c)), chr(10))"


LETTERED = options("chr(cast(64 + i AS int))")
NUMBERED = options("i")

# --- captions -----------------------------------------------------------------------------------

CAPTIONS = r"""
captions AS (SELECT doc_id sample_id, array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) generated,
               [text, regexp_replace(lower(text), '^\s*\S+\s+\S+\s*', '')] refs FROM documents)"""


def toks(sql: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({sql}), '{TOKEN}'), lambda t: t <> '')"


TURNS = """
captions AS (SELECT {'c': a.conv_id, 't': a.turn} sample_id, a.text generated, [b.text, b.text] refs
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
  WHERE a.role = 'assistant' AND b.role = 'user')"""

NGRAMS = f"""
sides AS (SELECT sample_id, 0 src, {toks('generated')} w FROM captions
          UNION ALL SELECT sample_id, 1, {toks('refs[1]')} FROM captions
          UNION ALL SELECT sample_id, 2, {toks('refs[2]')} FROM captions),
grams AS (SELECT sample_id, src, n, array_to_string(w[i : i + n - 1], ' ') g FROM
           (SELECT sample_id, src, n, w, unnest(range(1, len(w) - n + 2)) i FROM sides, range(1, 5) r(n))),
counted AS (SELECT sample_id, src, n, g, count(*) c FROM grams GROUP BY ALL),
matched AS (SELECT n, sum(least(p.c, coalesce(r.c, 0))) m, sum(p.c) t FROM (SELECT * FROM counted WHERE src = 0) p
            LEFT JOIN (SELECT sample_id, n, g, max(c) c FROM counted WHERE src > 0 GROUP BY ALL) r
            USING (sample_id, n, g) GROUP BY n),
lens AS (SELECT sum(p) c, sum(CASE WHEN abs(a - p) < abs(b - p) OR (abs(a - p) = abs(b - p) AND a < b) THEN a ELSE b END) r
         FROM (SELECT sample_id, max(CASE WHEN src = 0 THEN len(w) END) p, max(CASE WHEN src = 1 THEN len(w) END) a,
                 max(CASE WHEN src = 2 THEN len(w) END) b FROM sides GROUP BY sample_id))"""

OCCURRENCES = f"""
toks AS (SELECT sample_id, 0 src, {toks('generated')} w FROM captions
         UNION ALL SELECT sample_id, 1, {toks('refs[1]')} FROM captions),
pos AS (SELECT sample_id, src, unnest(w) t, generate_subscripts(w, 1) i FROM toks),
occ AS (SELECT *, row_number() OVER (PARTITION BY sample_id, src, t ORDER BY i) k FROM pos),
pairs AS (SELECT p.sample_id, p.i a, r.i b FROM occ p JOIN occ r USING (sample_id, t, k) WHERE p.src = 0 AND r.src = 1),
steps AS (SELECT *, lag(a) OVER w pa, lag(b) OVER w pb FROM pairs WINDOW w AS (PARTITION BY sample_id ORDER BY a)),
found AS (SELECT sample_id, count(*) m, sum(CASE WHEN a = pa + 1 AND b = pb + 1 THEN 0 ELSE 1 END) ch FROM steps GROUP BY 1),
sizes AS (SELECT sample_id, max(CASE WHEN src = 0 THEN len(w) END) p, max(CASE WHEN src = 1 THEN len(w) END) r
          FROM toks GROUP BY 1)"""

TURN_CAPTIONS = r"""
said AS (SELECT {'c': conv_id, 't': turn} sample_id, text, regexp_replace(text, '^\s*\S+\s+\S+\s*', '') ref
         FROM conversations WHERE role = 'assistant'),
captions AS (SELECT 'base' run_id, sample_id, text generated, ref FROM said
             UNION ALL SELECT 'pruned', sample_id, substr(text, 1, length(text) // 2), ref FROM said)"""


def lcs(source: str, keys: str, predicted: str, reference: str) -> str:
    """The dynamic program, one row of it per token of the prediction."""
    return f"""
pairs_ AS (SELECT {keys}, {predicted} p, {reference} r FROM {source}),
rows_ AS (SELECT {keys}, 0 i, list_transform(range(len(r) + 1), lambda x: 0) row_ FROM pairs_
  UNION ALL SELECT {", ".join("l." + k.strip() for k in keys.split(","))}, l.i + 1, list_transform(range(1, len(t.r) + 2), lambda j:
      greatest(l.row_[j], coalesce(list_max(list_transform(list_filter(range(1, j), lambda k: t.r[k] = t.p[l.i + 1]), lambda k: l.row_[k] + 1)), 0)))
  FROM rows_ l JOIN pairs_ t USING ({keys}) WHERE l.i < len(t.p)),
rouge AS (SELECT {keys}, CASE WHEN len(p) + len(r) = 0 THEN 0 ELSE 2.0 * row_[-1] / (len(p) + len(r)) END rouge_l
  FROM rows_ JOIN pairs_ USING ({keys}) WHERE i = len(p))"""


def caption_sides(reference: str) -> str:
    return f"""
sides AS (SELECT sample_id, 0 src, {toks('generated')} w FROM captions
          UNION ALL SELECT sample_id, 1, {toks(reference)} FROM captions)"""


# Porter's rules over shapes of letters; y is a vowel after a consonant.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
VOWEL = f"^({CONSONANTS}[aeiouy]|[aeiou])"
M_ABOVE_0 = f"{VOWEL}[aeiou]*{CONSONANTS}"
M_ABOVE_1 = f"{M_ABOVE_0}{VOWELS}{CONSONANTS}"
M_1 = f"{M_ABOVE_0}({VOWELS})?$"
SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"


def porter(source: str) -> str:
    """``stems (t, s)`` of the distinct words ``t`` of ``source``, step by step."""

    def has(sql: str, pattern: str) -> str:
        return f"regexp_matches({sql}, '{pattern}')"

    def cut(n: int) -> str:
        return f"left(s, length(s) - {n})"

    def by_suffix(suffixes, result) -> str:
        cases = " ".join(f"WHEN suffix(s, '{x}') THEN {result(x)}" for x in sorted(suffixes, key=len, reverse=True))
        return f"CASE {cases} ELSE s END"

    def past(x: str) -> str:
        stem = cut(len(x))
        double = f"right({stem}, 1) = left(right({stem}, 2), 1) AND length({stem}) > 1 AND NOT {has(f'right({stem}, 1)', '[aeiouylsz]')}"
        return f"""CASE WHEN NOT {has(stem, VOWEL)} THEN s WHEN {has(stem, '(at|bl|iz)$')} OR {has(stem, SHORT)} THEN concat({stem}, 'e')
          WHEN ({double}) OR {has(stem, '((^|[aeiou])y|[^aeiouy])(yy)+$')} THEN {cut(len(x) + 1)} ELSE {stem} END"""

    def replaced(table: dict[str, str]) -> str:
        return by_suffix(table, lambda x: f"CASE WHEN {has(cut(len(x)), M_ABOVE_0)} THEN concat({cut(len(x))}, '{table[x]}') ELSE s END")

    def derived(x: str) -> str:
        mark = f" AND {has(cut(3), '[st]$')}" if x == "ion" else ""
        return f"CASE WHEN {has(cut(len(x)), M_ABOVE_1)}{mark} THEN {cut(len(x))} ELSE s END"

    steps = [
        f"CASE WHEN {has('s', '(sses|ies)$')} THEN {cut(2)} WHEN {has('s', '(^|[^s])s$')} THEN {cut(1)} ELSE s END",
        f"CASE WHEN suffix(s, 'eed') THEN CASE WHEN {has(cut(3), M_ABOVE_0)} THEN {cut(1)} ELSE s END ELSE {by_suffix(('ed', 'ing'), past)} END",
        f"CASE WHEN suffix(s, 'y') AND {has(cut(1), VOWEL)} THEN concat({cut(1)}, 'i') ELSE s END",
        replaced(stem.STEP_2),
        replaced(stem.STEP_3),
        by_suffix(stem.STEP_4, derived),
        f"""CASE WHEN suffix(s, 'e') AND ({has(cut(1), M_ABOVE_1)} OR ({has(cut(1), M_1)} AND NOT {has(cut(1), SHORT)})) THEN {cut(1)} ELSE s END""",
        f"CASE WHEN suffix(s, 'll') AND {has('s', M_ABOVE_1)} THEN {cut(1)} ELSE s END",
    ]
    parts = [f"stem0 AS (SELECT DISTINCT t, t s FROM {source})"]
    parts += [f"stem{k + 1} AS MATERIALIZED (SELECT t, {step} s FROM stem{k})" for k, step in enumerate(steps)]
    return ",\n".join([*parts, f"stems AS (SELECT t, CASE WHEN length(t) > 2 THEN s ELSE t END s FROM stem{len(steps)})"])


def meteor(m: str = "m", ch: str = "ch") -> str:
    f_mean = f"10 * ({m} / p) * ({m} / r) / ({m} / r + 9 * ({m} / p))"
    return f"CASE WHEN {m} IS NULL THEN 0 ELSE {f_mean} * (1 - 0.5 * power({ch} / {m}, 3)) END"


def aligned(keys: str, *stages: str, name: str = "") -> str:
    """``found{name}`` (matches and chunks) from ``pos`` (keys, src, t, s, g, i): each stage pairs the k-th of a class on both sides."""
    own = [key.strip() for key in keys.split(",")]
    parts, free = [], "pos"
    for k, column in enumerate(stages):
        at = f"{k}{name}"
        parts.append(f"occ{at} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, src, {column} ORDER BY i) k FROM {free})")
        parts.append(f"""hit{at} AS MATERIALIZED (SELECT {", ".join("p." + key for key in own)}, p.i a, r.i b
            FROM occ{at} p JOIN occ{at} r USING ({keys}, {column}, k) WHERE p.src = 0 AND r.src = 1)""")
        parts.append(f"""free{at} AS MATERIALIZED (SELECT * FROM {free} ANTI JOIN
            (SELECT {keys}, 0 src, a i FROM hit{at} UNION ALL SELECT {keys}, 1, b FROM hit{at}) USING ({keys}, src, i))""")
        free = f"free{at}"
    every = " UNION ALL ".join(f"FROM hit{k}{name}" for k in range(len(stages)))
    parts.append(f"steps{name} AS (SELECT *, lag(a) OVER w pa, lag(b) OVER w pb FROM ({every}) WINDOW w AS (PARTITION BY {keys} ORDER BY a))")
    parts.append(f"""found{name} AS (SELECT {keys}, count(*) m, sum(CASE WHEN a = pa + 1 AND b = pb + 1 THEN 0 ELSE 1 END) ch
        FROM steps{name} GROUP BY ALL)""")
    return ",\n".join(parts)


def word_positions(keys: str) -> str:
    """``pos`` with stems and starts of words, and ``sizes``, from ``sides`` (keys, src, w)."""
    return f"""
said_ AS (SELECT {keys}, src, unnest(w) t, generate_subscripts(w, 1) i FROM sides),
{porter("said_")},
pos AS MATERIALIZED (SELECT said_.*, s, substr(t, 1, 5) g FROM said_ JOIN stems USING (t)),
sizes AS (SELECT {keys}, max(CASE WHEN src = 0 THEN len(w) END) p, max(CASE WHEN src = 1 THEN len(w) END) r FROM sides GROUP BY ALL)"""


#: The longest common subsequence of two texts by thresholds: ``s[k]`` is the least place of the reference at which a
#: common subsequence of k words ends, ``x[v]`` the first place from v on with the prediction's next word.
THRESHOLDS = f"""
sides AS (SELECT sample_id, {toks('generated')} p, {toks('refs[1]')} r FROM captions),
places AS (SELECT sample_id, t, list(j ORDER BY j) js, any_value(n) n
  FROM (SELECT sample_id, len(r) n, unnest(r) t, unnest(range(1, len(r) + 1)) j FROM sides) GROUP BY ALL),
nexts AS (SELECT sample_id, t, flatten(list_transform(list_zip(list_append(js, n + 1), list_prepend(0, js)),
    lambda z: list_resize(cast([] AS int[]), z[1] - z[2], CASE WHEN z[1] <= n THEN cast(z[1] AS int) END))) x FROM places),
hits AS (SELECT sample_id, list(x ORDER BY i) h FROM (SELECT sample_id, unnest(p) t, unnest(range(len(p))) i FROM sides)
  JOIN nexts USING (sample_id, t) GROUP BY sample_id),
folded AS (SELECT sample_id, len(list_reduce(h, lambda s, x: list_filter(list_transform(list_zip(list_append(s, NULL),
    list_select(x, list_prepend(1, list_transform(s, lambda v: v + 1)))), lambda z: least(z[1], z[2])), lambda v: v IS NOT NULL),
    cast([] AS int[]))) n FROM hits)"""


METRICS = f"""
sides AS (SELECT run_id, sample_id, 0 src, {toks('generated')} w FROM captions
          UNION ALL SELECT run_id, sample_id, 1, {toks('ref')} FROM captions),
grams AS (SELECT run_id, sample_id, src, n, array_to_string(w[i : i + n - 1], ' ') g FROM
           (SELECT *, unnest(range(1, len(w) - n + 2)) i FROM sides, range(1, 5) r(n))),
counted AS (SELECT run_id, sample_id, src, n, g, count(*) c FROM grams GROUP BY ALL),
matched AS (SELECT run_id, n, sum(least(p.c, coalesce(r.c, 0))) m, sum(p.c) t FROM (SELECT * FROM counted WHERE src = 0) p
            LEFT JOIN (SELECT * FROM counted WHERE src = 1) r USING (run_id, sample_id, n, g) GROUP BY ALL),
lens AS (SELECT run_id, sum(CASE WHEN src = 0 THEN len(w) END) c, sum(CASE WHEN src = 1 THEN len(w) END) r FROM sides GROUP BY 1),
bleu AS (SELECT run_id, CASE WHEN min(m) = 0 THEN 0 ELSE exp(avg(CASE WHEN m > 0 THEN ln(m / t) END)) END * max(CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END) v
         FROM matched JOIN lens USING (run_id) GROUP BY run_id),
{word_positions("run_id, sample_id").strip()},
{aligned("run_id, sample_id", "t", "s")},
meteor AS (SELECT run_id, avg({meteor()}) v FROM sizes LEFT JOIN found USING (run_id, sample_id) GROUP BY run_id),
{lcs("captions", "run_id, sample_id", toks("generated"), toks("ref")).strip()},
metrics AS (SELECT run_id, 'bleu4' metric, v FROM bleu UNION ALL SELECT run_id, 'rougeL', avg(rouge_l) FROM rouge GROUP BY 1
            UNION ALL SELECT run_id, 'meteor', v FROM meteor)"""

SHOWN = f"""
shown AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 sample_idx, sample_id coco_id,
            CASE WHEN {strip('generated')} = '' THEN '(empty)' ELSE {strip('generated')} END generated,
            array_to_string([{strip('refs[1]')}, {strip('refs[2]')}], concat(chr(10), '---', chr(10))) refs,
            cast(2 AS int) n_refs FROM captions)"""
FILE_NAME = "printf('sample_%03d_coco%d.jpg', sample_idx, coco_id) img_file"

# --- logs ---------------------------------------------------------------------------------------

ENERGY = """
energy AS (SELECT concat('user_', user_id) project_name, event_type run_id, event_id, ts, value * 0.37 cpu_energy,
             value * 0.54 gpu_energy, value * 0.09 ram_energy, value energy_consumed, value * 0.43 emissions FROM events)"""


def last_energy(key: str) -> str:
    return f"""
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) rn FROM energy)
         WHERE rn = 1)"""


SPEED = """
speed AS (SELECT event_type run_id, count(*) n_samples, avg(value) mean_latency_ms, stddev_pop(value) std_latency_ms,
            max(value) peak, strftime(min(ts), '%Y%m%d_%H%M%S') stamp,
            (max(epoch_us(ts) + cast(round(value * 1000) AS bigint)) - min(epoch_us(ts))) / 1e6 total_time_s
          FROM events GROUP BY 1)"""
LOSSES = """
log AS (SELECT event_type run_id, cast(1 AS int) epoch,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) batch_idx,
          CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END loss FROM events),
running AS (SELECT *, count(*) OVER (PARTITION BY run_id, epoch) batches,
              round(coalesce(sum(loss) OVER w, 0), 4) / count(*) OVER w running_loss
            FROM log WINDOW w AS (PARTITION BY run_id, epoch ORDER BY batch_idx ROWS UNBOUNDED PRECEDING))"""

# --- tokens -------------------------------------------------------------------------------------

TOKENS = r"""
w AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) pos FROM
       (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') w FROM documents)),
voc AS (SELECT word, row_number() OVER (ORDER BY word) id FROM (SELECT DISTINCT word FROM w)),
found AS (SELECT doc_id, list(cast(id AS int) ORDER BY pos) input_ids FROM w JOIN voc USING (word) GROUP BY doc_id),
ids AS (SELECT doc_id, coalesce(input_ids, []) input_ids FROM documents LEFT JOIN found USING (doc_id))"""
EXAMPLES = """
halves AS (SELECT doc_id, input_ids[1 : len(input_ids) // 2][1:512] p, input_ids[len(input_ids) // 2 + 1 :][1:512] c FROM ids),
ex AS (SELECT doc_id, list_concat(p, c) input_ids, list_transform(list_concat(p, c), lambda x: 1) attention_mask,
         list_concat(list_transform(p, lambda x: -100), c) labels FROM halves)"""


def csv_text(sql: str, name: str) -> str:
    return f"array_to_string({sql}, ',') {name}"


def padded(sql: str, length: str, value: int) -> str:
    return f"list_concat({sql}, list_transform(range({length} - len({sql})), lambda x: {value}))"


def permuted(n: str, seed: int, epoch: int) -> str:
    """``walk`` of every ``row_idx`` of ``numbered`` through the rounds until it is below ``n`` (a scalar subquery)."""
    order = Permutation(1, seed)

    def hashed(x: str, key: int) -> str:
        first, second = order.FACTORS
        return f"((((((({x} + {key}) & {order.MASK}) * {first}) & {order.MASK}) >> {order.SHIFT}) * {second}) & {order.MASK})"

    def once(number: str) -> str:
        steps, keys = f"SELECT {number} // r x, {number} % r y, l, r", order.keys(epoch)
        for k in range(0, len(keys), 2):
            steps = f"SELECT (x + {hashed('y', keys[k])}) % l x, y, l, r FROM ({steps})"
            steps = f"SELECT x, (y + {hashed('x', keys[k + 1])}) % r y, l, r FROM ({steps})"
        return f"(SELECT x * r + y FROM ({steps}))"

    return f"""
sized{epoch} AS (SELECT n, l, cast(ceil(n / l) AS bigint) r FROM (SELECT n, cast(floor(sqrt(n - 1)) AS bigint) + 1 l FROM (SELECT {n} n))),
walk{epoch} AS (SELECT row_idx, {once('row_idx')} v, n, l, r FROM numbered, sized{epoch}
  UNION ALL SELECT row_idx, {once('v')}, n, l, r FROM walk{epoch} WHERE v >= n)"""


def oracle_queries() -> dict[str, str]:
    """SQL by query name."""
    sql: dict[str, str] = {}
    row = "n, block_start, block_end, round(average_distance, 6) average_distance"
    sql["block_distance_all"] = with_parts(*LAYERED, select=f"SELECT {row} FROM dist")
    sql["bucketed_block_distance"] = sql["block_distance_all"]
    sql["block_distance_n"] = with_parts(*LAYERED, select=f"SELECT {row} FROM dist WHERE n = 3")
    sql["best_block"] = with_parts(*LAYERED, BEST, select=f"SELECT {row} FROM best")
    sql["pair_layers"] = with_parts(
        *LAYERED, select="SELECT block_start, round(average_distance, 6) average_distance FROM dist WHERE n = 5"
    )
    sql["apply_plans"] = with_parts(
        *LAYERED, BEST, "layers AS (SELECT DISTINCT l - 1 l FROM h)",
        select="SELECT 'm24' model, n, cast(l AS int) layer FROM best, layers WHERE l <= block_start OR l > block_end",
    )
    sql["report_names"] = """
        SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END n,
          CASE WHEN p_size % 2 = 0 THEN cast(p_size AS varchar) ELSE list_extract(string_split(p_name, ' '), -1) END AS label,
          CASE WHEN p_size = 2 THEN 'base' END base_label FROM part"""
    sql["min_distance"] = with_parts(
        *LAYERED,
        select="""SELECT n, round(min(average_distance), 6) min_distance,
                    arg_min(block_start, (average_distance, block_start)) - 1 layer_idx,
                    string_agg(printf('%.6f', average_distance), ',' ORDER BY block_start) mean_distances
                  FROM dist GROUP BY n""",
    )
    sql["distance_matrix"] = matrix("block_start")
    sql["distance_matrix_end"] = matrix("block_end - 1")
    sql["last_token_state"] = """
        SELECT sample_id, layer, max(pos) pos, round(arg_max(sz, pos), 6) norm FROM
          (SELECT cast(floor(vec_id / 20) AS bigint) sample_id, cast(floor(vec_id / 5) % 4 AS int) layer,
             cast(vec_id % 5 AS int) pos,
             sqrt(list_inner_product(cast(embedding AS double[]), cast(embedding AS double[]))) sz
           FROM embeddings WHERE vec_id % 5 <= floor(vec_id / 20) % 5)
        GROUP BY 1, 2"""
    sql["batch_assign"] = """
        SELECT doc_id, row_idx, row_idx // 32 batch_id FROM
          (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 row_idx, count(*) OVER () total FROM documents)
        WHERE row_idx < total - total % 32"""
    batches = """
    b AS (SELECT s, i // 4 batch_id FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 i, count(*) OVER () t
           FROM (SELECT DISTINCT cast(floor(vec_id / 25) AS bigint) s FROM embeddings)) WHERE i < t - t % 4)"""
    sql["batch_block_distance"] = with_parts(
        STATES, PAIRS, batches,
        select="""SELECT batch_id, n, block_start, round(avg(x), 6) average_distance FROM d JOIN b USING (s)
                  GROUP BY 1, 2, 3""",
    )
    sql["shuffled_batches"] = """
        SELECT doc_id, row_idx, row_idx // 2 batch_id FROM
          (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7:', doc_id)), doc_id) - 1 row_idx FROM documents)"""
    sql["model_block_distance"] = with_parts(
        letter_states(), PAIRS, DIST, select="SELECT n, block_start, round(average_distance, 6) average_distance FROM dist"
    )
    sql["report_round_trip"] = with_parts(
        *LAYERED, BEST, "sizes AS (SELECT cast(n AS int) n FROM range(1, 25) r(n))",
        select="""SELECT 'driver' dataset, 'm24' model, n, d.block_start, d.block_end,
                    round(d.average_distance, 6) average_distance, b.block_start best_start, b.block_end best_end
                  FROM sizes LEFT JOIN dist d USING (n) LEFT JOIN best b USING (n)""",
    )

    keep = {
        "half_open": "l < block_start OR l >= block_end",
        "left_open": "l <= block_start OR l > block_end",
        "closed": "l < block_start OR l > block_end",
    }
    sql["prune_keep_layers"] = with_parts(
        *LAYERED, BEST,
        select=" UNION ALL ".join(
            f"SELECT '{rule}' AS \"rule\", n, cast(l AS int) layer FROM best, range({N_LAYERS}) r(l) WHERE {test}"
            for rule, test in keep.items()
        ),
    )
    sql["prune_plan_slices"] = with_parts(
        *LAYERED, BEST,
        """s AS (SELECT n, 0 k, 0 layer_from, block_start layer_to FROM best
                 UNION ALL SELECT n, 1, block_end, 24 FROM best)""",
        select="""SELECT 'm24' model, n, cast(row_number() OVER (PARTITION BY n ORDER BY k) - 1 AS int) slice_idx,
                    cast(layer_from AS int) layer_from, cast(layer_to AS int) layer_to,
                    'passthrough' merge_method, 'bfloat16' dtype FROM s WHERE layer_from < layer_to""",
    )
    sql["performance_curve"] = with_parts(
        *LAYERED, BEST, *ANSWERS,
        """acc AS (SELECT cast(item_id % 25 AS int) n, avg(cast(coalesce(code - 65 = truth, false) AS int)) a
                   FROM parsed GROUP BY 1)""",
        select="""SELECT 'm24' model, n, block_start, block_end, round(a, 6) accuracy FROM acc LEFT JOIN best USING (n)""",
    )
    sql["accuracy_history"] = with_parts(
        *ANSWERS,
        select="""SELECT run_id, seq, round(avg(cast(coalesce(code - 65 = truth, false) AS int)), 6) accuracy
                  FROM parsed, range(1, 3) r(seq) GROUP BY 1, 2""",
    )

    sql["corpus_first_n"] = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100"
    sql["corpus_first_third"] = """
        SELECT doc_id, length(text) size FROM documents ORDER BY size NULLS FIRST, doc_id LIMIT (SELECT count(*) // 3 FROM documents)"""
    sql["epoch_orders"] = with_parts(
        "numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 row_idx FROM documents)",
        permuted("(SELECT count(*) FROM documents)", 7, 0), permuted("(SELECT count(*) FROM documents)", 7, 1),
        recursive=True,
        select=" UNION ALL ".join(
            f"SELECT doc_id, cast({k} AS int) epoch, v place, v // 32 batch_id FROM walk{k} JOIN numbered USING (row_idx) WHERE v < n" for k in (0, 1)
        ),
    )
    sql["items_of_split"] = with_parts(
        ITEMS,
        select="SELECT item_id, question, cast(len(choices) AS int) n_choices, answer FROM items WHERE answer <> 0",
    )
    plain = f"concat('Question: ', question, chr(10), {LETTERED}, chr(10), 'Answer:') prompt"
    sql["prompt_mmlu"] = with_parts(
        ITEMS,
        select="SELECT item_id, concat('Choose the correct answer from the options below.', chr(10), prompt) prompt "
        f"FROM (SELECT item_id, {plain} FROM items)",
    )
    sql["prompt_mmlu_plain"] = with_parts(ITEMS, select=f"SELECT item_id, {plain} FROM items")
    sql["prompt_hellaswag"] = with_parts(
        ITEMS,
        select="""SELECT item_id, concat('Sentence: ', question, chr(10), 'Options: [''',
                    array_to_string(choices, ''', '''), ''']', chr(10), 'Answer:') prompt FROM items""",
    )
    marked = "concat(replace(text, 'e', chr(39)), chr(92), replace(substr(text, 1, 9), 'n', chr(34)))"
    sql["prompt_hellaswag_texts"] = f"""
        SELECT doc_id item_id, concat('Sentence: Go on', chr(10), 'Options: [', {quoted('text')}, ', ', {quoted(marked)}, ', "it''s"]',
          chr(10), 'Answer:') prompt FROM documents"""
    sql["truth_hellaswag"] = "SELECT l_orderkey item_id, cast(l_linenumber AS int) truth FROM lineitem"
    sql["prompt_truthfulqa"] = with_parts(
        ITEMS,
        select=f"SELECT item_id, concat('Question: ', question, chr(10), {NUMBERED}, chr(10), 'Answer:') prompt FROM items",
    )
    sql["truth_truthfulqa"] = with_parts(ITEMS, select="SELECT item_id, answer truth FROM items")
    sql["parse_choice"] = with_parts(
        *ANSWERS,
        select="""SELECT item_id, coalesce(code - 65, -1) predicted, coalesce(code - 64, -1) predicted_from_one,
                    coalesce(code - 49, -1) predicted_digit FROM parsed""",
    )
    sql["choice_accuracy"] = with_parts(
        ITEMS, *ANSWERS,
        select="""SELECT run_id, cast(sum(ok) AS bigint) correct, count(*) total, round(avg(ok), 6) accuracy FROM
                    (SELECT run_id, cast(coalesce(code - 65 = answer, false) AS int) ok FROM parsed JOIN items USING (item_id))
                  GROUP BY run_id""",
    )
    sql["generate_answers"] = with_parts(
        ITEMS,
        f"asked AS (SELECT item_id, answer, cast(length(prompt) + 50 AS int) % 4 p FROM (SELECT item_id, answer, {plain} FROM items))",
        select="""SELECT item_id, concat('Answer: ', chr(65 + p)) response, p predicted, p = answer correct FROM asked""",
    )
    sql["prompt_instruction"] = with_parts(
        INSTRUCTIONS,
        select=f"""SELECT conv_id, turn, concat('Instruction: ', instruction, chr(10),
                     CASE WHEN {strip('context')} <> '' THEN concat('Context: ', context, chr(10)) ELSE '' END,
                     'Answer:') prompt, response completion FROM instructions""",
    )
    sql["chat_messages"] = with_parts(
        INSTRUCTIONS,
        select="""SELECT conv_id, turn, 'user' AS "role", cast(part AS int) part,
                    CASE part WHEN 0 THEN 'image' ELSE 'text' END AS "type",
                    CASE part WHEN 1 THEN instruction END AS "text", concat('<|image|>', chr(10), instruction) plain
                  FROM instructions, range(2) r(part)""",
    )

    fields = ", ".join(
        f"cast(max(CASE WHEN n = {n} THEN {v} END) AS bigint) {name}_{n}"
        for v, name in (("m", "match"), ("t", "total")) for n in (1, 2, 3, 4)
    )
    sql["bleu4"] = with_parts(
        CAPTIONS, NGRAMS,
        f"s AS (SELECT {fields}, avg(ln(m / t)) lp FROM matched)",
        select="""SELECT s.* EXCLUDE (lp), cast(c AS bigint) pred_len, cast(r AS bigint) ref_len,
                    round(CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * exp(lp), 6) bleu4 FROM s, lens""",
    )
    sql["bleu4_matched"] = with_parts(
        TURNS,
        NGRAMS,
        f"s AS (SELECT {fields}, avg(CASE WHEN m > 0 THEN ln(m / t) END) lp, min(m) least FROM matched)",
        select="""SELECT match_1, match_2, match_3, match_4, cast(c AS bigint) pred_len, cast(r AS bigint) ref_len,
                    round(CASE WHEN least = 0 THEN 0 WHEN c > r THEN exp(lp) ELSE exp(1 - r / c) * exp(lp) END, 6) bleu4
                  FROM s, lens""",
    )
    sql["rouge_l_turns"] = with_parts(
        """said AS (SELECT a.conv_id, a.turn, a.text x, b.text y FROM conversations a JOIN conversations b
             ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant' AND b.role = 'user')""",
        lcs("said", "conv_id, turn", toks("x"), toks("y")), recursive=True,
        select="SELECT conv_id, turn, round(rouge_l, 6) rouge_l FROM rouge",
    )
    sql["meteor_synonym_turns"] = with_parts(
        f"""sides AS (SELECT a.conv_id, a.turn, s.src, CASE s.src WHEN 0 THEN {toks('a.text')} ELSE {toks('b.text')} END w
              FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1, range(2) s(src)
              WHERE a.role = 'assistant' AND b.role = 'user')""",
        "pos AS (SELECT conv_id, turn, src, unnest(w) t, generate_subscripts(w, 1) i FROM sides)",
        "occ AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, src, t ORDER BY i) k FROM pos)",
        """equal AS (SELECT p.conv_id, p.turn, p.i a, r.i b FROM occ p JOIN occ r USING (conv_id, turn, t, k)
                     WHERE p.src = 0 AND r.src = 1)""",
        """rest AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, src, substr(t, 1, 5) ORDER BY i) q FROM occ o
              WHERE NOT EXISTS (FROM equal e WHERE e.conv_id = o.conv_id AND e.turn = o.turn
                                AND o.i = CASE o.src WHEN 0 THEN e.a ELSE e.b END))""",
        """hits AS (FROM equal UNION ALL SELECT p.conv_id, p.turn, p.i, r.i FROM rest p JOIN rest r ON p.conv_id = r.conv_id
              AND p.turn = r.turn AND p.q = r.q AND substr(p.t, 1, 5) = substr(r.t, 1, 5) WHERE p.src = 0 AND r.src = 1)""",
        "steps AS (SELECT *, lag(a) OVER w pa, lag(b) OVER w pb FROM hits WINDOW w AS (PARTITION BY conv_id, turn ORDER BY a))",
        """found AS (SELECT conv_id, turn, count(*) m, sum(CASE WHEN a = pa + 1 AND b = pb + 1 THEN 0 ELSE 1 END) ch
                     FROM steps GROUP BY ALL)""",
        """sizes AS (SELECT conv_id, turn, max(CASE WHEN src = 0 THEN len(w) END) p, max(CASE WHEN src = 1 THEN len(w) END) r
                     FROM sides GROUP BY ALL)""",
        select="""SELECT conv_id, turn, round(CASE WHEN m IS NULL THEN 0 ELSE
                      10 * (m / p) * (m / r) / (m / r + 9 * (m / p)) * (1 - 0.5 * power(ch / m, 3)) END, 6) meteor
                  FROM sizes LEFT JOIN found USING (conv_id, turn)""",
    )
    sql["meteor_stem_turns"] = with_parts(
        TURNS, caption_sides("refs[1]"), word_positions("sample_id"),
        aligned("sample_id", "t", "s", name="_stem"), aligned("sample_id", "t", "s", "g"),
        "stemmed AS (SELECT sample_id, m ms, ch chs FROM found_stem)",
        select=f"""SELECT sample_id.c conv_id, sample_id.t turn, round({meteor('ms', 'chs')}, 6) meteor_stem,
                     round({meteor()}, 6) meteor FROM sizes LEFT JOIN found USING (sample_id) LEFT JOIN stemmed USING (sample_id)""",
    )
    sql["meteor_full"] = with_parts(
        CAPTIONS, caption_sides("refs[1]"), word_positions("sample_id"), aligned("sample_id", "t", "s"),
        select=f"SELECT count(*) n_samples, round(avg({meteor()}), 6) meteor FROM sizes LEFT JOIN found USING (sample_id)",
    )
    sql["rouge_l"] = with_parts(
        CAPTIONS, THRESHOLDS,
        select="""SELECT count(*) n_samples, round(avg(coalesce(2.0 * n / nullif(len(p) + len(r), 0), 0)), 6) rouge_l
                  FROM sides LEFT JOIN folded USING (sample_id)""",
    )
    scored = (TURN_CAPTIONS, METRICS)
    sql["caption_scores"] = with_parts(
        *scored, recursive=True, select="SELECT run_id, metric, round(v, 6) AS \"value\" FROM metrics"
    )
    sql["caption_quality_gate"] = with_parts(
        *scored, recursive=True,
        select="""SELECT metric, round(b.v, 6) baseline, round(c.v, 6) candidate, round(c.v / nullif(b.v, 0), 6) ratio,
                    round(0.8 * b.v, 6) target, c.v >= 0.8 * b.v passed
                  FROM metrics b JOIN metrics c USING (metric) WHERE b.run_id = 'base' AND c.run_id = 'pruned'""",
    )
    numbers = {
        "speed.total_time_s": "round(sum(x) / 7, 2)", "speed.throughput_samples_per_s": "round(count(*) * 7 / sum(x), 3)",
        "speed.mean_latency_ms": "round(avg(x), 1)", "speed.std_latency_ms": "round(stddev_pop(x), 1)",
        "energy.energy_kwh": "round(sum(x) / 3e6, 6)", "energy.co2_kg": "round(sum(x) / 7e6, 6)",
        "hardware.peak_vram_mib": "round(max(x) / 3, 1)", "hardware.total_vram_mib": "round(max(x) / 0.7, 1)",
    }
    measured = " UNION ALL ".join(f"SELECT run_id, '{k}' metric, cast({v} AS double) v FROM sized GROUP BY 1" for k, v in numbers.items())
    sql["caption_run_record"] = with_parts(
        *scored, "sized AS (SELECT run_id, cast(length(generated) AS double) x FROM captions)",
        f"every AS (SELECT run_id, concat('quality.', metric) metric, round(v, 4) v FROM metrics UNION ALL {measured})",
        "counts AS (SELECT run_id, count(*) n_samples FROM captions GROUP BY 1)",
        recursive=True,
        select="""SELECT run_id, 'm24' model_id, n_samples, cast(3.142 AS double) "n_params_B", metric, v AS "value"
                  FROM every JOIN counts USING (run_id)""",
    )
    sql["meteor_exact"] = with_parts(
        CAPTIONS, OCCURRENCES,
        select="""SELECT sample_id, round(CASE WHEN m IS NULL THEN 0 ELSE
                      10 * (m / p) * (m / r) / (m / r + 9 * (m / p)) * (1 - 0.5 * power(ch / m, 3)) END, 6) meteor
                  FROM sizes LEFT JOIN found USING (sample_id)""",
    )
    sql["caption_envelope"] = with_parts(
        CAPTIONS, SHOWN,
        select=f"""SELECT 'm24' model_id, 'Name what you see.' prompt, sample_idx, coco_id, {FILE_NAME}, generated, refs FROM shown""",
    )
    sql["comparison_rows"] = with_parts(CAPTIONS, SHOWN, select=f"SELECT *, {FILE_NAME} FROM shown")
    sql["caption_round_trip"] = with_parts(
        CAPTIONS, SHOWN,
        select=f"""SELECT 'm24' model_id, 'Name what you see.' prompt, sample_idx, coco_id,
                    printf('http://images.example.com/%d.jpg', coco_id) url, {FILE_NAME}, generated, refs FROM shown""",
    )
    sql["first_sentence"] = with_parts(
        CAPTIONS,
        select=r"SELECT sample_id, regexp_extract(generated, '^\s*([^\n.!?]*[.!?]?)', 1) first_sentence FROM captions",
    )
    sql["output_flags"] = with_parts(
        CAPTIONS,
        f"""f AS (SELECT sample_id, regexp_matches(lower(generated), '\\n\\s*(?:{HEADINGS})\\b|\\n[^\\n]*\\?') has_suffix,
               list_filter(list_transform(string_split(generated, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') ls,
               {toks('generated')} ts FROM captions)""",
        select="""SELECT sample_id, has_suffix, round(len(ls) / nullif(len(list_distinct(ls)), 0), 6) line_repetition,
                    round(len(ts) / nullif(len(list_distinct(ts)), 0), 6) token_repetition FROM f""",
    )
    fetched = "SELECT url FROM pages WHERE page_id % 7 <> 0 AND html IS NOT NULL"
    sql["normalised_refs"] = """
        SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN concat(text, chr(10), '---', chr(10), lower(text)) ELSE text END refs
        FROM documents"""
    sql["payload_files"] = """
        SELECT cast(strlen(t) AS bigint) length, md5(t) digest FROM
          (SELECT string_agg(concat(url, chr(10)), '' ORDER BY page_id) t FROM pages GROUP BY page_id % 16)"""
    sql["payload_bodies"] = "SELECT page_id, cast(strlen(html) AS bigint) length, md5(html) digest FROM pages"
    sql["payload_lengths"] = "SELECT url, CASE WHEN page_id % 3 <> 0 THEN cast(strlen(html) AS bigint) END length FROM pages"
    sql["payload_present"] = f"SELECT url, page_id FROM pages WHERE url IN ({fetched})"
    sql["payload_missing"] = f"SELECT url, page_id FROM pages WHERE url NOT IN ({fetched})"

    sql["run_pairs"] = """
        WITH r AS (SELECT event_type run_id, avg(value) mean, max(value) mx FROM events GROUP BY 1),
        v AS (SELECT run_id, 'mean' metric, mean x FROM r UNION ALL SELECT run_id, 'max', mx FROM r)
        SELECT b.run_id baseline_run, c.run_id candidate_run, metric, round(b.x, 6) baseline, round(c.x, 6) candidate,
          round(c.x / nullif(b.x, 0), 6) ratio FROM v b JOIN v c USING (metric) WHERE b.run_id = (SELECT min(run_id) FROM r)"""
    sql["latency_summary"] = with_parts(
        SPEED,
        select="""SELECT run_id, n_samples, round(mean_latency_ms, 6) mean_latency_ms,
                    round(std_latency_ms, 6) std_latency_ms FROM speed""",
    )
    sql["throughput"] = with_parts(
        SPEED,
        select="""SELECT run_id, n_samples, round(total_time_s, 6) total_time_s,
                    round(n_samples / total_time_s, 6) samples_per_s FROM speed""",
    )
    sql["peak_memory"] = "SELECT event_type run_id, max(value) peak_memory_mib FROM events GROUP BY 1"
    sql["energy_last"] = with_parts(
        ENERGY, last_energy("project_name"),
        select="""SELECT project_name, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
                    round(energy_consumed, 6) energy_consumed, round(emissions, 6) emissions FROM last""",
    )
    sql["energy_share"] = with_parts(
        ENERGY, last_energy("project_name"),
        select=" UNION ALL ".join(
            f"SELECT project_name, '{c}' component, round({c}_energy, 6) energy, "
            f"round({c}_energy / nullif(energy_consumed, 0), 6) share FROM last"
            for c in ("cpu", "gpu", "ram")
        ),
    )
    sql["energy_per_sample"] = with_parts(
        ENERGY,
        select="""SELECT project_name, count(*) n_samples, round(sum(energy_consumed) * 1e3 / count(*), 6) wh_per_sample,
                    round(sum(emissions) * 1e6 / count(*), 6) co2_mg_per_sample FROM energy GROUP BY 1""",
    )
    sql["energy_totals"] = with_parts(
        ENERGY,
        select="""SELECT round(arg_max(energy_consumed, ts), 6) energy_kwh, round(arg_max(emissions, ts), 6) co2_kg FROM energy""",
    )
    sql["energy_log_round_trip"] = with_parts(
        ENERGY,
        select="""SELECT project_name, count(*) n_rows, round(sum(cpu_energy), 6) cpu_energy,
                    strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_at FROM energy GROUP BY 1""",
    )
    metrics = {
        "speed.total_time_s": "round(total_time_s, 2)",
        "speed.throughput_samples_per_s": "round(n_samples / total_time_s, 3)",
        "speed.mean_latency_ms": "round(mean_latency_ms, 1)",
        "speed.std_latency_ms": "round(std_latency_ms, 1)",
        "energy.energy_kwh": "round(energy_consumed, 6)",
        "energy.co2_kg": "round(emissions, 6)",
        "hardware.peak_vram_mib": "round(peak, 1)",
    }
    sql["run_result_record"] = with_parts(
        SPEED, ENERGY, last_energy("run_id"),
        select=" UNION ALL ".join(
            f"SELECT stamp run_id, run_id model_id, n_samples, cast(2.718 AS double) \"n_params_B\", "
            f"'{name}' metric, cast({value} AS double) AS \"value\" FROM speed JOIN last USING (run_id)"
            for name, value in metrics.items()
        ),
    )
    sql["quality_gate"] = """
        SELECT metric, round(b, 6) baseline, round(c, 6) candidate, round(c / nullif(b, 0), 6) ratio,
          round(0.8 * b, 6) target, c >= 0.8 * b passed FROM
          (SELECT event_type metric, avg(value) FILTER (hour(ts) < 12) b, avg(value) FILTER (hour(ts) >= 12) c
           FROM events GROUP BY 1)"""
    sql["stream_latency"] = """
        SELECT event_type run_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') window_start, count(*) n_samples,
          round(sum(value) / count(*), 6) mean_latency_ms FROM events GROUP BY 1, 2"""

    sql["epoch_loss"] = with_parts(
        LOSSES,
        select="""SELECT run_id, epoch, count(*) batches, round(sum(loss) / count(*), 6) average_loss,
                    count(loss) valid_batches, round(avg(loss), 6) valid_loss FROM log GROUP BY 1, 2""",
    )
    sql["running_loss"] = with_parts(LOSSES, select="SELECT run_id, epoch, batch_idx, running_loss FROM running")
    sql["stream_running_loss"] = sql["running_loss"]
    sql["stream_epoch_loss"] = with_parts(
        LOSSES,
        select="""SELECT run_id, epoch, count(*) batches, count(loss) valid_batches, round(sum(loss) / count(*), 6) average_loss
                  FROM log GROUP BY 1, 2""",
    )
    sql["running_loss_progress"] = with_parts(
        LOSSES,
        select="""SELECT run_id, epoch, batch_idx, batches, running_loss FROM running
                  WHERE batch_idx % greatest(batches // 100, 1) = 0 AND loss IS NOT NULL""",
    )
    sql["token_ids"] = with_parts(TOKENS, select=f"SELECT doc_id, {csv_text('input_ids', 'input_ids')} FROM ids")
    cut = "input_ids[1:128]"
    sql["pad_fixed"] = with_parts(
        TOKENS,
        select=f"""SELECT doc_id, {csv_text(padded(cut, '128', 0), 'input_ids')},
                     {csv_text(padded(f'list_transform({cut}, lambda x: 1)', '128', 0), 'attention_mask')} FROM ids""",
    )
    columns = ("input_ids", "attention_mask", "labels")
    sql["train_labels"] = with_parts(
        TOKENS, EXAMPLES, select=f"SELECT doc_id, {', '.join(csv_text(c, c) for c in columns)} FROM ex"
    )
    fill = {"input_ids": 0, "attention_mask": 0, "labels": -100}
    sql["collate_pad"] = with_parts(
        TOKENS, EXAMPLES,
        "numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 batch_id FROM ex)",
        "sized AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) m FROM numbered)",
        select=f"SELECT batch_id, doc_id, {', '.join(csv_text(padded(c, 'm', v), c) for c, v in fill.items())} FROM sized",
    )
    return {name: textwrap.dedent(text).strip() for name, text in sql.items()}
