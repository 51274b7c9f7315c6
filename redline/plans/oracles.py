"""DuckDB oracle SQL, one per registered query (same column names).

Every query starts from the same ``gec_pairs`` derivation as the Spark side and
runs over whole tables. LCS and alignment are computed with nested
``list_reduce`` dynamic programming after trimming the common prefix and suffix
(exact for the LCS length; for the alignment only the suffix is trimmed).
"""

from __future__ import annotations

from redline.functions.text import DUCK_WS
from redline.sources.fixtures import GEC_PAIRS_SQL


def _tok(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{DUCK_WS}'), lambda x: x <> '')"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{DUCK_WS}|{DUCK_WS}$', '', 'g')"


def _norm(expr: str) -> str:
    return f"array_to_string({_tok(f'lower({expr})')}, ' ')"


def _h(seed, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


BASE = f"""
pairs AS ({GEC_PAIRS_SQL}),
raw_en AS (SELECT pair_id, incorrect AS modified, correct AS sentence, transformation
           FROM pairs WHERE lang = 'en'),
raw_multi AS (SELECT pair_id, incorrect AS modified, correct AS sentence, transformation, lang
              FROM pairs WHERE lang <> 'en'),
clean AS (
  SELECT pair_id, incorrect, correct, transformation, lang FROM (
    SELECT pair_id, modified AS incorrect, sentence AS correct, transformation, 'en' AS lang FROM raw_en
    UNION ALL
    SELECT pair_id, modified, sentence, transformation, 'es' FROM raw_multi WHERE lang = 'es') u
  WHERE incorrect IS NOT NULL AND correct IS NOT NULL AND transformation IS NOT NULL
    AND lang IS NOT NULL AND {_strip('incorrect')} <> '' AND {_strip('correct')} <> ''),
noop0 AS (
  SELECT pair_id, {_strip('modified')} AS s0, {_strip('sentence')} AS target, 'en' AS lang FROM raw_en
  UNION ALL
  SELECT pair_id, {_strip('modified')}, {_strip('sentence')}, {_strip('lang')} FROM raw_multi),
noop AS (
  SELECT pair_id, source, target, lang FROM (
    SELECT pair_id, CASE WHEN starts_with(lower(s0), 'fix grammar:')
                         THEN {_strip('substr(s0, 13)')} ELSE s0 END AS source, target, lang
    FROM noop0)
  WHERE source IS NOT NULL AND target IS NOT NULL AND lang IS NOT NULL
    AND source <> '' AND target <> '' AND source <> target),
splitted AS (
  SELECT *, CASE WHEN {_h(42, 'correct')} % 10 < 8 THEN 'train'
                 WHEN {_h(42, 'correct')} % 10 < 9 THEN 'val' ELSE 'test' END AS split
  FROM clean),
sampled AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_h(42, 'pair_id')}, pair_id) AS rn
    FROM splitted WHERE split = 'test') WHERE rn <= 200)
"""


def with_base(body: str) -> str:
    return f"WITH {BASE}, {body}"


def lcs_ctes(src: str, a: str, b: str, prefix: str = "l") -> tuple[str, str]:
    """CTEs adding column ``lcs`` = LCS length of list columns ``a`` and ``b``
    of relation ``src``; returns (cte text, name of the last CTE)."""
    p = prefix
    dp = ("list_reduce(a2, lambda prev, x: list_reduce(range(1, len(b2) + 1), "
          "lambda cur, j: list_append(cur, greatest(prev[j + 1], cur[j], "
          "CASE WHEN x = b2[j] THEN prev[j] + 1 ELSE 0 END)), [0]), "
          "list_transform(range(0, len(b2) + 1), lambda z: 0))[-1]")
    text = f"""
{p}1 AS (SELECT *, {a} AS a1, {b} AS b1 FROM {src}),
{p}2 AS (SELECT *, least(len(a1), len(b1)) AS mn FROM {p}1),
{p}3 AS (SELECT *, coalesce(list_position(list_transform(range(1, mn + 1), lambda i: a1[i] = b1[i]), false) - 1, mn) AS cp FROM {p}2),
{p}4 AS (SELECT *, coalesce(list_position(list_transform(range(0, mn - cp), lambda i: a1[len(a1) - i] = b1[len(b1) - i]), false) - 1, mn - cp) AS cs FROM {p}3),
{p}5 AS (SELECT *, a1[cp + 1:len(a1) - cs] AS a2, b1[cp + 1:len(b1) - cs] AS b2 FROM {p}4),
{p}6 AS (SELECT * EXCLUDE (a1, b1, a2, b2, mn, cp, cs), CAST(cp + cs + {dp} AS BIGINT) AS lcs FROM {p}5)"""
    return text, f"{p}6"


def _report_lcs(src: str, total: bool = True) -> str:
    cte, last = lcs_ctes(src, _tok("lower(prediction)"), _tok("lower(reference)"))
    grp = "ROLLUP(lang)" if total else "lang"
    lang = "CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END" if total else "lang"
    return f"""{cte.strip()},
rows AS (SELECT lang, lcs, len({_tok('lower(prediction)')}) AS n_pred,
                len({_tok('lower(reference)')}) AS n_ref,
                CAST({_norm('prediction')} = {_norm('reference')} AS BIGINT) AS hit FROM {last}),
g AS (SELECT {lang} AS lang, count(*) AS n_rows,
             CAST(coalesce(sum(lcs), 0) AS BIGINT) AS lcs, CAST(coalesce(sum(n_pred), 0) AS BIGINT) AS n_pred,
             CAST(coalesce(sum(n_ref), 0) AS BIGINT) AS n_ref, CAST(coalesce(sum(hit), 0) AS BIGINT) AS hits
      FROM rows GROUP BY {grp})
SELECT lang, n_rows, lcs, n_pred, n_ref,
       lcs / (n_pred + 1e-8) AS precision, lcs / (n_ref + 1e-8) AS recall,
       1.25 * (lcs / (n_pred + 1e-8)) * (lcs / (n_ref + 1e-8))
         / (0.25 * (lcs / (n_pred + 1e-8)) + lcs / (n_ref + 1e-8) + 1e-8) AS f05,
       CASE WHEN n_rows = 0 THEN 0.0 ELSE hits / n_rows END AS exact_match
FROM g"""


IDENTITY_ALL = "ident AS (SELECT pair_id, lang, incorrect AS prediction, correct AS reference FROM clean)"


ORACLES: dict[str, str] = {}

ORACLES["gec_pairs"] = with_base("x AS (SELECT 1) SELECT * FROM pairs")
ORACLES["corpus_clean"] = with_base("x AS (SELECT 1) SELECT * FROM clean")
ORACLES["corpus_noop_filtered"] = with_base("x AS (SELECT 1) SELECT * FROM noop")
ORACLES["lang_counts"] = with_base(
    "x AS (SELECT 1) SELECT lang, count(*) AS n FROM noop WHERE lang IS NOT NULL GROUP BY lang")
ORACLES["split_lang_counts"] = with_base(
    "x AS (SELECT 1) SELECT split, lang, count(*) AS n FROM splitted GROUP BY split, lang")
ORACLES["split_exact"] = with_base(f"""
r AS (SELECT pair_id, lang, row_number() OVER (ORDER BY {_h(42, 'pair_id')}, pair_id) - 1 AS idx,
             count(*) OVER () AS n FROM clean)
SELECT pair_id, lang, CASE WHEN idx < n - ceil(0.2 * n) THEN 'train'
                           WHEN idx < n - ceil(0.5 * ceil(0.2 * n)) THEN 'val' ELSE 'test' END AS split
FROM r""")
ORACLES["split_75_25"] = with_base(f"""
r AS (SELECT pair_id, lang, row_number() OVER (ORDER BY {_h(42, 'pair_id')}, pair_id) - 1 AS idx,
             count(*) OVER () AS n FROM noop)
SELECT pair_id, lang, CASE WHEN idx < floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM r""")
ORACLES["sample_per_lang"] = with_base("x AS (SELECT 1) SELECT pair_id, lang FROM sampled")
ORACLES["tokens_norm"] = with_base(f"""
x AS (SELECT 1)
SELECT pair_id, CAST(len({_tok('incorrect')}) AS INTEGER) AS n_tokens, {_norm('incorrect')} AS norm,
       {_strip('incorrect')} AS stripped
FROM pairs WHERE incorrect IS NOT NULL""")

_lcs_cte, _lcs_last = lcs_ctes("clean", _tok("incorrect"), _tok("correct"))
ORACLES["lcs_pairs"] = with_base(f"{_lcs_cte.strip()} SELECT pair_id, lcs FROM {_lcs_last}")
ORACLES["f05_lcs_by_lang"] = with_base(f"{IDENTITY_ALL}, {_report_lcs('ident')}")
ORACLES["f05_set_by_lang"] = with_base(f"""{IDENTITY_ALL},
rows AS (SELECT lang, {_tok('lower(prediction)')} AS p, {_tok('lower(reference)')} AS r FROM ident),
c AS (SELECT lang, len(list_intersect(p, r)) AS tp,
             len(list_filter(list_distinct(p), lambda x: NOT list_contains(r, x))) AS fp,
             len(list_filter(list_distinct(r), lambda x: NOT list_contains(p, x))) AS fn FROM rows),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, count(*) AS n_rows,
             CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp,
             CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn
      FROM c GROUP BY ROLLUP(lang))
SELECT lang, n_rows, tp, fp, fn, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall,
       1.25 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8))
         / (0.25 * (tp / (tp + fp + 1e-8)) + tp / (tp + fn + 1e-8) + 1e-8) AS f05
FROM g""")
ORACLES["exact_match_by_lang"] = with_base(f"""{IDENTITY_ALL}
SELECT lang, count(*) AS n_rows, CAST(sum(CAST({_norm('prediction')} = {_norm('reference')} AS BIGINT)) AS BIGINT) AS hits,
       CAST(sum(CAST({_norm('prediction')} = {_norm('reference')} AS BIGINT)) AS BIGINT) / count(*) AS exact_match
FROM ident GROUP BY lang""")
ORACLES["eval_identity"] = with_base(
    "ev AS (SELECT pair_id, lang, incorrect AS prediction, correct AS reference FROM sampled), "
    + _report_lcs("ev"))


# ---------------------------------------------------------------- alignment, edits, vocab

def align_ctes(src: str, a: str, b: str, prefix: str = "al") -> tuple[str, str]:
    """CTEs adding ``src_tok``, ``tgt_tok``, ``al`` (list of {s, t}, 0-based) and
    ``labels`` to relation ``src``. Full DP table after common-suffix trimming,
    then the backtrace as a ``list_reduce`` over a {i, j, al} state."""
    p = prefix
    row = ("list_reduce(range(1, len(b2) + 1), lambda cur, j: list_append(cur, greatest("
           "tbl[-1][j + 1], cur[j], CASE WHEN x = b2[j] THEN tbl[-1][j] + 1 ELSE 0 END)), [0])")
    table = (f"list_reduce(a2, lambda tbl, x: list_append(tbl, {row}), "
             "[list_transform(range(0, len(b2) + 1), lambda z: 0)])")
    step = ("CASE WHEN st.i = 0 OR st.j = 0 THEN st "
            "WHEN a2[st.i] = b2[st.j] THEN {'i': st.i - 1, 'j': st.j - 1, "
            "'al': list_append(st.al, {'s': st.i - 1, 't': st.j - 1})} "
            "WHEN tbl[st.i][st.j + 1] >= tbl[st.i + 1][st.j] THEN {'i': st.i - 1, 'j': st.j, 'al': st.al} "
            "ELSE {'i': st.i, 'j': st.j - 1, 'al': st.al} END")
    init = "{'i': len(a2), 'j': len(b2), 'al': CAST([] AS STRUCT(s INTEGER, t INTEGER)[])}"
    gap = ("CASE WHEN x.t > 0 THEN '$REPLACE_' || tgt_tok[x.t] ELSE '$DELETE' END")
    prev_s = "CASE WHEN k = 1 THEN -1 ELSE al[k - 1].s END"
    prev_t = "CASE WHEN k = 1 THEN -1 ELSE al[k - 1].t END"
    own = f"CASE WHEN x.t > ({prev_t}) + 1 THEN '$INSERT_' || tgt_tok[({prev_t}) + 2] ELSE '$KEEP' END"
    piece = (f"list_concat(list_transform(range(x.s - ({prev_s}) - 1), lambda q: {gap}), [{own}])")
    last_s = "CASE WHEN len(al) = 0 THEN -1 ELSE al[-1].s END"
    text = f"""
{p}1 AS (SELECT *, {a} AS src_tok, {b} AS tgt_tok FROM {src}),
{p}2 AS (SELECT *, least(len(src_tok), len(tgt_tok)) AS mn FROM {p}1),
{p}3 AS (SELECT *, coalesce(list_position(list_transform(range(0, mn), lambda i: src_tok[len(src_tok) - i] = tgt_tok[len(tgt_tok) - i]), false) - 1, mn) AS cs FROM {p}2),
{p}4 AS (SELECT *, src_tok[1:len(src_tok) - cs] AS a2, tgt_tok[1:len(tgt_tok) - cs] AS b2 FROM {p}3),
{p}5 AS (SELECT *, {table} AS tbl FROM {p}4),
{p}6 AS (SELECT *, list_reduce(range(1, len(a2) + len(b2) + 1), lambda st, stp: {step}, {init}) AS bt FROM {p}5),
{p}7 AS (SELECT * EXCLUDE (mn, a2, b2, tbl, bt, cs),
         list_concat(list_reverse(bt.al), list_transform(range(0, cs), lambda q:
           {{'s': CAST(len(src_tok) - cs + q AS INTEGER), 't': CAST(len(tgt_tok) - cs + q AS INTEGER)}})) AS al
         FROM {p}6),
{p}8 AS (SELECT *, list_concat(flatten(list_transform(al, lambda x, k: {piece})),
                               list_transform(range(len(src_tok) - 1 - ({last_s})), lambda q: '$DELETE')) AS labels
         FROM {p}7)"""
    return text, f"{p}8"


def _apply(src: str, labels: str) -> str:
    return (f"array_to_string(flatten(list_transform(range(1, len({src}) + 1), lambda i: CASE "
            f"WHEN {labels}[i] = '$KEEP' THEN [{src}[i]] "
            f"WHEN {labels}[i] = '$DELETE' THEN CAST([] AS VARCHAR[]) "
            f"WHEN starts_with({labels}[i], '$REPLACE_') THEN [substr({labels}[i], 10)] "
            f"WHEN starts_with({labels}[i], '$INSERT_') THEN [substr({labels}[i], 9), {src}[i]] "
            f"ELSE [{src}[i]] END)), ' ')")


_al_cte, _al_last = align_ctes("clean", _tok("incorrect"), _tok("correct"))
_al_train, _al_train_last = align_ctes("(SELECT * FROM splitted WHERE split = 'train')",
                                       _tok("incorrect"), _tok("correct"), prefix="tr")
EDITS_TRAIN = f"""{_al_train.strip()},
edits AS (SELECT pair_id, lang, unnest(range(0, len(src_tok))) AS pos, unnest(src_tok) AS token,
                 unnest(labels) AS label FROM {_al_train_last}),
lc AS (SELECT label, count(*) AS freq, min({{'p': pair_id, 'q': pos}}).p AS first_pair,
              min({{'p': pair_id, 'q': pos}}).q AS first_pos FROM edits GROUP BY label),
top AS (SELECT * FROM lc ORDER BY freq DESC, first_pair, first_pos LIMIT 5000),
vocab AS (
  SELECT '$KEEP' AS label, 0 AS label_id, coalesce((SELECT freq FROM lc WHERE label = '$KEEP'), 0) AS freq
  UNION ALL SELECT '$DELETE', 1, coalesce((SELECT freq FROM lc WHERE label = '$DELETE'), 0)
  UNION ALL SELECT label, CAST(row_number() OVER (ORDER BY freq DESC, first_pair, first_pos) + 1 AS INTEGER), freq
  FROM top WHERE label NOT IN ('$KEEP', '$DELETE'))"""

ORACLES["align_pairs"] = with_base(f"""{_al_cte.strip()}
SELECT pair_id, array_to_string(list_transform(al, lambda x: x.s || ':' || x.t), ' ') AS alignment,
       len(al) AS n_matches FROM {_al_last}""")
ORACLES["edit_table"] = with_base(f"""{_al_cte.strip()}
SELECT pair_id, lang, unnest(range(0, len(src_tok))) AS pos, unnest(src_tok) AS token,
       unnest(labels) AS label FROM {_al_last}""")
ORACLES["apply_gold_edits"] = with_base(f"""{_al_cte.strip()}
SELECT pair_id, {_apply('src_tok', 'labels')} AS applied FROM {_al_last}""")
ORACLES["roundtrip_audit"] = with_base(f"""{_al_cte.strip()}
SELECT lang, transformation, count(*) AS n_pairs,
       CAST(sum(CAST({_apply('src_tok', 'labels')} = array_to_string(tgt_tok, ' ') AS BIGINT)) AS BIGINT) AS n_roundtrip,
       sum(CAST({_apply('src_tok', 'labels')} = array_to_string(tgt_tok, ' ') AS BIGINT)) / count(*) AS share
FROM {_al_last} GROUP BY lang, transformation""")
ORACLES["label_counts"] = with_base(f"{EDITS_TRAIN} SELECT label, freq, first_pair, first_pos FROM lc")
ORACLES["label_vocab"] = with_base(f"{EDITS_TRAIN} SELECT label, CAST(label_id AS INTEGER) AS label_id, freq FROM vocab")
ORACLES["label_ids"] = with_base(f"""{EDITS_TRAIN}
SELECT e.pair_id, e.pos, CAST(coalesce(v.label_id, 0) AS INTEGER) AS label_id
FROM edits e LEFT JOIN vocab v USING (label)""")


# ---------------------------------------------------------------- tagger

def _ctx_rows(rel: str, tok: str, with_labels: bool) -> str:
    lab = ", unnest(labels) AS label" if with_labels else ""
    return (f"SELECT pair_id, lang, pos, CASE WHEN pos = 0 THEN '<s>' ELSE {tok}[pos] END AS prev, word, "
            f"coalesce({tok}[pos + 2], '</s>') AS next{', label' if with_labels else ''} FROM ("
            f"SELECT pair_id, lang, {tok}, unnest(range(0, len({tok}))) AS pos, unnest({tok}) AS word{lab} FROM {rel})")


TAGGER_FIT = f"""{EDITS_TRAIN},
tctx AS (SELECT c.*, CAST(coalesce(v.label_id, 0) AS INTEGER) AS label_id
         FROM ({_ctx_rows(_al_train_last, 'src_tok', True)}) c LEFT JOIN vocab v USING (label)),
c_tri AS (SELECT lang, prev, word, next, label_id, count(*) AS n FROM tctx GROUP BY ALL),
c_bi AS (SELECT lang, prev, word, label_id, count(*) AS n FROM tctx GROUP BY ALL),
c_uni AS (SELECT lang, word, label_id, count(*) AS n FROM tctx GROUP BY ALL),
m_tri AS (SELECT lang, prev, word, next, first(label_id ORDER BY n DESC, label_id) AS tri_id, CAST(sum(n) AS BIGINT) AS tri_n FROM c_tri GROUP BY ALL),
m_bi AS (SELECT lang, prev, word, first(label_id ORDER BY n DESC, label_id) AS bi_id, CAST(sum(n) AS BIGINT) AS bi_n FROM c_bi GROUP BY ALL),
m_uni AS (SELECT lang, word, first(label_id ORDER BY n DESC, label_id) AS uni_id, CAST(sum(n) AS BIGINT) AS uni_n FROM c_uni GROUP BY ALL)"""


def _pass(k: int, src: str) -> str:
    """One correction pass over relation ``src`` (pair_id, lang, txt, used, done)."""
    return f"""
p{k}t AS (SELECT *, {_tok('txt')} AS tk FROM {src}),
p{k}w AS ({_ctx_rows(f'p{k}t', 'tk', False)}),
p{k}l AS (SELECT w.pair_id, w.pos, coalesce(v.label, '$KEEP') AS label
          FROM p{k}w w LEFT JOIN m_tri t USING (lang, prev, word, next)
          LEFT JOIN m_bi b USING (lang, prev, word) LEFT JOIN m_uni u USING (lang, word)
          LEFT JOIN vocab v ON v.label_id = coalesce(t.tri_id, b.bi_id, u.uni_id, 0)),
p{k}g AS (SELECT pair_id, list(label ORDER BY pos) AS labels FROM p{k}l GROUP BY pair_id),
p{k}a AS (SELECT t.pair_id, t.lang, t.txt, t.used, t.done,
                 {_apply('t.tk', "coalesce(g.labels, CAST([] AS VARCHAR[]))")} AS nxt
          FROM p{k}t t LEFT JOIN p{k}g g USING (pair_id)),
p{k} AS (SELECT pair_id, lang,
                CASE WHEN done OR nxt = txt THEN txt ELSE nxt END AS txt,
                CASE WHEN done THEN used ELSE {k} END AS used,
                done OR nxt = txt AS done FROM p{k}a)"""


def correct_ctes(src: str, passes: int = 3) -> str:
    out = [_pass(1, src)]
    for k in range(2, passes + 1):
        out.append(_pass(k, f"p{k - 1}"))
    return ",".join(out)


TAG_INPUT = ("tin AS (SELECT pair_id, lang, incorrect AS txt, 0 AS used, false AS done "
             "FROM splitted WHERE split = 'test')")
ORACLES["tagger_fit"] = with_base(f"""{TAGGER_FIT}
SELECT 'tri' AS level, lang, prev, word, next, tri_id AS label_id, tri_n AS n_ctx FROM m_tri
UNION ALL SELECT 'bi', lang, prev, word, NULL, bi_id, bi_n FROM m_bi
UNION ALL SELECT 'uni', lang, NULL, word, NULL, uni_id, uni_n FROM m_uni""")
ORACLES["tagger_tag"] = with_base(f"""{TAGGER_FIT}, {TAG_INPUT}, {_pass(1, 'tin')}
SELECT t.pair_id, array_to_string(coalesce(g.labels, CAST([] AS VARCHAR[])), ' ') AS labels
FROM p1t t LEFT JOIN p1g g USING (pair_id)""")
ORACLES["correct_iter"] = with_base(f"""{TAGGER_FIT}, {TAG_INPUT}, {correct_ctes('tin', 3)}
SELECT pair_id, txt AS corrected, used AS passes_used FROM p3""")
_EV_IN = ("tin AS (SELECT pair_id, lang, incorrect AS txt, 0 AS used, false AS done FROM sampled)")
ORACLES["eval_tagger"] = with_base(f"""{TAGGER_FIT}, {_EV_IN}, {correct_ctes('tin', 3)},
ev AS (SELECT s.pair_id, s.lang, p3.txt AS prediction, s.correct AS reference
       FROM sampled s JOIN p3 USING (pair_id)), {_report_lcs('ev')}""")
_SYS = f"""{TAGGER_FIT}, {_EV_IN}, {correct_ctes('tin', 3)},
both_sys AS (SELECT 'identity' AS system, lang, incorrect AS prediction, correct AS reference FROM sampled
             UNION ALL
             SELECT 'tagger', s.lang, p3.txt, s.correct FROM sampled s JOIN p3 USING (pair_id)),
rows AS (SELECT system, lang, {_tok('lower(prediction)')} AS p, {_tok('lower(reference)')} AS r FROM both_sys),
c AS (SELECT system, lang, len(list_intersect(p, r)) AS tp,
             len(list_filter(list_distinct(p), lambda x: NOT list_contains(r, x))) AS fp,
             len(list_filter(list_distinct(r), lambda x: NOT list_contains(p, x))) AS fn FROM rows),
g AS (SELECT system, lang, count(*) AS n_rows, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
             CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY system, lang)
SELECT system, lang, n_rows, tp, fp, fn, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall,
       1.25 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8))
         / (0.25 * (tp / (tp + fp + 1e-8)) + tp / (tp + fn + 1e-8) + 1e-8) AS f05
FROM g"""
ORACLES["system_compare"] = with_base(_SYS)

_al_val, _al_val_last = align_ctes("(SELECT * FROM splitted WHERE split = 'val')",
                                   _tok("incorrect"), _tok("correct"), prefix="va")
ORACLES["val_loss"] = with_base(f"""{TAGGER_FIT}, {_al_val.strip()},
vctx AS (SELECT c.*, CAST(coalesce(v.label_id, 0) AS INTEGER) AS label_id
         FROM ({_ctx_rows(_al_val_last, 'src_tok', True)}) c LEFT JOIN vocab v USING (label)),
nv AS (SELECT count(*) AS v FROM vocab),
j AS (SELECT x.pair_id, t.tri_n, b.bi_n, u.uni_n, gt.n AS tri_g, gb.n AS bi_g, gu.n AS uni_g
      FROM vctx x LEFT JOIN m_tri t USING (lang, prev, word, next) LEFT JOIN m_bi b USING (lang, prev, word)
      LEFT JOIN m_uni u USING (lang, word)
      LEFT JOIN c_tri gt USING (lang, prev, word, next, label_id)
      LEFT JOIN c_bi gb USING (lang, prev, word, label_id) LEFT JOIN c_uni gu USING (lang, word, label_id)),
nll AS (SELECT pair_id, -ln((CASE WHEN tri_n IS NOT NULL THEN coalesce(tri_g, 0)
                                  WHEN bi_n IS NOT NULL THEN coalesce(bi_g, 0)
                                  WHEN uni_n IS NOT NULL THEN coalesce(uni_g, 0) ELSE 0 END + 1)
                             / (coalesce(tri_n, bi_n, uni_n, 0) + (SELECT v FROM nv))) AS nll FROM j),
vb AS (SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 32 AS batch
       FROM splitted WHERE split = 'val'),
pb AS (SELECT batch, CAST(sum(CAST(nll AS DECIMAL(24, 12))) AS DOUBLE) / count(*) AS mean,
              count(*) AS n FROM nll JOIN vb USING (pair_id) GROUP BY batch)
SELECT round(CAST(sum(CAST(mean AS DECIMAL(24, 12))) AS DOUBLE) / count(*), 9) AS val_loss,
       count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n_tokens FROM pb""")


# ---------------------------------------------------------------- prompts, encoding, candidates, runs

# System instructions by language, the prompts' pieces and, below, the reply prefixes.
_SYS_EN = ("You are a grammatical error correction assistant. "
           "Correct all grammatical errors in the given sentence. "
           "Output ONLY the corrected sentence — no explanation, no extra text.")
_SYS_ES = ("Eres un asistente de corrección gramatical. "
           "Corrige todos los errores gramaticales en la oración dada. "
           "Devuelve ÚNICAMENTE la oración corregida — sin explicaciones ni texto adicional.")
NL = "chr(10)"


def _zs(s: str) -> str:
    return f"('Sentence: ' || {s} || {NL} || 'Corrected:')"


def _wrap(msg: str, lang: str) -> str:
    return (f"('<s>[INST] ' || CASE WHEN {lang} = 'en' THEN '{_SYS_EN}' ELSE '{_SYS_ES}' END "
            f"|| {NL} || {NL} || {msg} || ' [/INST]')")


RANKED = f"""
rk AS (SELECT *, row_number() OVER (ORDER BY {_h(42, 'pair_id')}, pair_id) - 1 AS idx,
              count(*) OVER () AS n FROM noop),
rs AS (SELECT *, CASE WHEN idx < floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM rk),
pick AS (SELECT * FROM rs WHERE split = 'train' AND lang = 'en'
         AND len({_tok('source')}) > 5 AND len({_tok('source')}) < 25 ORDER BY idx LIMIT 3),
blk AS (SELECT coalesce(string_agg('Sentence: ' || source || {NL} || 'Corrected: ' || target,
                                   {NL} || {NL} ORDER BY idx), '') AS block FROM pick),
ptest AS (SELECT * FROM rs WHERE split = 'test' AND lang IN ('en', 'es'))"""

ORACLES["few_shot_pick"] = with_base(f"{RANKED} SELECT pair_id, source, target FROM pick")
ORACLES["zero_shot_prompts"] = with_base(f"{RANKED} SELECT pair_id, lang, {_wrap(_zs('source'), 'lang')} AS prompt FROM ptest")
ORACLES["few_shot_prompts"] = with_base(f"""{RANKED}
SELECT pair_id, lang, {_wrap(f"CASE WHEN lang = 'es' THEN {_zs('source')} ELSE (SELECT block FROM blk) || {NL} || {NL} || 'Sentence: ' || source || {NL} || 'Corrected:' END", 'lang')} AS prompt
FROM ptest""")

_prefixes = ["Corrected:", "Corrected sentence:", "Answer:", "Corregida:", "Oración corregida:"]
_steps = []
for _i, _p in enumerate(_prefixes):
    _steps.append(f"rc{_i + 1} AS (SELECT pair_id, source, had_error, CASE WHEN starts_with(lower(t), lower('{_p}')) "
                  f"THEN {_strip(f'substr(t, {len(_p) + 1})')} ELSE t END AS t FROM rc{_i})")
ORACLES["reply_clean"] = with_base(f"""{RANKED},
rp AS (SELECT pair_id, source, target, {_wrap(_zs('source'), 'lang')} AS prompt,
              CASE {_h(7, 'pair_id')} % 6 WHEN 0 THEN 'Corrected: ' || target
                   WHEN 1 THEN 'Answer: Corrected: ' || target WHEN 2 THEN '  '
                   WHEN 3 THEN 'corregida:  ' || target || ' '
                   WHEN 4 THEN 'Corrected: Answer: ' || target ELSE NULL END AS reply FROM ptest),
rc0 AS (SELECT pair_id, source, reply IS NULL AS had_error,
               {_strip(f"substr(prompt || ' ' || reply, length(prompt) + 1)")} AS t FROM rp),
{", ".join(_steps)}
SELECT pair_id, coalesce(nullif(t, ''), source) AS prediction, had_error FROM rc5""")

TRAIN_TOK = f"""
ttok AS (SELECT pair_id, lang, {_tok('incorrect')} AS src_tok, {_tok('correct')} AS tgt_tok
         FROM splitted WHERE split = 'train'),
tv0 AS (SELECT token, count(*) AS freq FROM (SELECT unnest(src_tok) AS token FROM ttok
                                             UNION ALL SELECT unnest(tgt_tok) FROM ttok) GROUP BY token),
tvocab AS (SELECT token, CAST(row_number() OVER (ORDER BY {_h(42, 'token')}, token) - 1 + 4 AS INTEGER) AS token_id, freq
           FROM tv0)"""


def _ids(col: str, name: str) -> str:
    return f"""{name} AS (SELECT pair_id, list(coalesce(v.token_id, 3) ORDER BY pos) AS ids FROM (
      SELECT pair_id, unnest(range(0, len({col}))) AS pos, unnest({col}) AS token FROM ttok) w
      LEFT JOIN tvocab v USING (token) GROUP BY pair_id)"""


def _frame(ids: str) -> str:
    seq = f"list_concat([0], coalesce({ids}, [])[1:126], [2])"
    return f"list_concat({seq}, list_transform(range(128 - len({seq})), lambda q: 1))"


def _ints(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ' ')"


ORACLES["token_vocab"] = with_base(f"{TRAIN_TOK} SELECT token, token_id, freq FROM tvocab")
ORACLES["encode_seq2seq"] = with_base(f"""{TRAIN_TOK}, {_ids('src_tok', 'sid')}, {_ids('tgt_tok', 'tid')},
fr AS (SELECT t.pair_id, {_frame('s.ids')} AS src, {_frame('g.ids')} AS tgt
       FROM ttok t LEFT JOIN sid s USING (pair_id) LEFT JOIN tid g USING (pair_id))
SELECT pair_id, {_ints('src')} AS input_ids,
       {_ints('list_transform(src, lambda x: CASE WHEN x = 1 THEN 0 ELSE 1 END)')} AS attention_mask,
       {_ints('tgt[1:127]')} AS tgt_input,
       {_ints('list_transform(tgt[2:128], lambda x: CASE WHEN x = 1 THEN -100 ELSE x END)')} AS tgt_output
FROM fr""")
ORACLES["encode_tags"] = with_base(f"""{EDITS_TRAIN},
lid AS (SELECT e.pair_id, list(CAST(coalesce(v.label_id, 0) AS INTEGER) ORDER BY e.pos) AS lids
        FROM edits e LEFT JOIN vocab v USING (label) GROUP BY e.pair_id),
x AS (SELECT a.pair_id, len(a.src_tok) AS n, l.lids FROM {_al_train_last} a LEFT JOIN lid l USING (pair_id)),
w AS (SELECT pair_id, lids, list_concat([NULL], list_transform(range(0, least(n, 126)), lambda i: CAST(i AS INTEGER)),
                                    [NULL]) AS w0 FROM x),
w2 AS (SELECT pair_id, lids, list_concat(w0, list_transform(range(128 - len(w0)), lambda q: CAST(NULL AS INTEGER))) AS wids FROM w)
SELECT pair_id, {_ints("list_transform(wids, lambda wd, i: CASE WHEN wd IS NULL THEN -100 WHEN i > 1 AND wids[i - 1] = wd THEN -100 ELSE coalesce(lids[wd + 1], -100) END)")} AS labels
FROM w2""")
ORACLES["argmax_labels"] = with_base(f"""{EDITS_TRAIN},
am AS (SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label_id FROM embeddings)
SELECT vec_id, label_id, coalesce(v.label, '$KEEP') AS label FROM am LEFT JOIN vocab v USING (label_id)""")
CANDS = """
cands AS (SELECT sent_id, CAST(rank AS INTEGER) AS rank, CAST(score AS DOUBLE) AS score,
                 CAST(2 + (sent_id + rank) % 7 AS INTEGER) AS n_tokens,
                 (sent_id + rank) % 3 <> 0 AND sent_id % 5 <> 0 AS finished, 'cand-' || CAST(rank AS VARCHAR) AS text
          FROM (SELECT vec_id AS sent_id, unnest(range(0, len(embedding))) AS rank, unnest(embedding) AS score
                FROM embeddings))"""
ORACLES["nbest_select"] = with_base(f"""{CANDS},
g AS (SELECT sent_id, bool_or(finished) AS any_finished,
             first({{'text': text, 'rank': rank}} ORDER BY score / n_tokens DESC, rank) FILTER (WHERE finished) AS fin,
             first({{'text': text, 'rank': rank}} ORDER BY score DESC, rank) AS raw FROM cands GROUP BY sent_id)
SELECT sent_id, CASE WHEN any_finished THEN fin.text ELSE raw.text END AS text,
       CASE WHEN any_finished THEN fin.rank ELSE raw.rank END AS rank, any_finished FROM g""")
ORACLES["top_candidates"] = with_base(f"""{CANDS}
SELECT sent_id, rank, pos FROM (SELECT sent_id, rank, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, rank) AS INTEGER) AS pos
                                FROM cands) WHERE pos <= 4""")
ORACLES["minibatches"] = with_base(f"""
r AS (SELECT pair_id, row_number() OVER (ORDER BY {_h(42, "'0|' || CAST(pair_id AS VARCHAR)")}, pair_id) - 1 AS batch_pos
      FROM splitted WHERE split = 'train')
SELECT pair_id, CAST(floor(batch_pos / 32) AS BIGINT) AS batch, batch_pos FROM r""")
RUNS = """
rt AS (SELECT user_id AS run_id, CAST(dayofmonth(ts) AS INTEGER) AS epoch,
              sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100.0 AS val_loss
       FROM events GROUP BY ALL)"""
ORACLES["best_run"] = with_base(f"""{RUNS},
sv AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM rt)
SELECT run_id, first(epoch ORDER BY val_loss, epoch) AS best_epoch, min(val_loss) AS best_val_loss,
       CAST(sum(CASE WHEN bb IS NULL OR val_loss < bb THEN 1 ELSE 0 END) AS BIGINT) AS n_saves, count(*) AS n_epochs
FROM sv GROUP BY run_id""")
# The default run configuration.
_DEFAULTS = [("freeze_encoder", "false"), ("d_model", "512"), ("num_heads", "8"), ("d_ff", "2048"),
             ("num_layers", "4"), ("max_len", "128")]
_dvals = " UNION ALL ".join(f"SELECT '{k}' AS key, '{v}' AS dv" for k, v in _DEFAULTS)
ORACLES["run_config"] = with_base(f"""
d AS ({_dvals}),
sk AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events)
SELECT e.event_id, d.key, coalesce(json_extract_string(e.props, '$."' || d.key || '"'), d.dv) AS value
FROM events e, d
UNION ALL
SELECT event_id, key, json_extract_string(props, '$."' || key || '"') FROM sk WHERE key NOT IN (SELECT key FROM d)""")
_na = ", ".join("''" if t == "" else f"'{t}'" for t in
                ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))
ORACLES["csv_roundtrip"] = with_base(f"""
x AS (SELECT pair_id, CASE WHEN incorrect IN ({_na}) THEN NULL ELSE incorrect END AS incorrect,
             CASE WHEN correct IN ({_na}) THEN NULL ELSE correct END AS correct,
             CASE WHEN transformation IN ({_na}) THEN NULL ELSE transformation END AS transformation,
             CASE WHEN lang IN ({_na}) THEN NULL ELSE lang END AS lang FROM clean)
SELECT * FROM x WHERE incorrect IS NOT NULL AND correct IS NOT NULL""")

ORACLES["preview"] = with_base("x AS (SELECT 1) SELECT pair_id, incorrect, correct FROM clean ORDER BY pair_id LIMIT 5")
ORACLES["distinct_langs"] = with_base("x AS (SELECT 1) SELECT DISTINCT lang FROM raw_multi WHERE lang IS NOT NULL")
ORACLES["report_rounded"] = f"""
SELECT *, round(precision, 4) AS precision_r4, round(recall, 4) AS recall_r4, round(f05, 4) AS f05_r4,
       round(exact_match, 4) AS exact_match_r4
FROM ({with_base(f"{IDENTITY_ALL}, {_report_lcs('ident')}")}) rep"""


# ---------------------------------------------------------------- stores and plug points

ORACLES["raw_build"] = ORACLES["corpus_clean"]
ORACLES["csv_mixed_layouts"] = ORACLES["csv_roundtrip"].replace(
    "SELECT * FROM x WHERE", "SELECT * REPLACE (CASE WHEN pair_id % 3 <> 2 THEN pair_id END AS pair_id) FROM x WHERE")


def _lang_vocab(top_k: int) -> str:
    fixed = " UNION ALL ".join(
        f"SELECT lang, '{x}' AS label, {i} AS label_id, CAST(coalesce(sum(freq) FILTER (label = '{x}'), 0) AS BIGINT) AS freq FROM llc GROUP BY lang"
        for i, x in enumerate(("$KEEP", "$DELETE")))
    return f"""{_al_train.strip()},
edits AS (SELECT pair_id, lang, unnest(range(0, len(src_tok))) AS pos, unnest(labels) AS label FROM {_al_train_last}),
llc AS (SELECT lang, label, count(*) AS freq, min({{'p': pair_id, 'q': pos}}) AS seen FROM edits GROUP BY lang, label),
ltop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, seen) AS r FROM llc) WHERE r <= {top_k}),
vocab AS ({fixed} UNION ALL
  SELECT lang, label, CAST(row_number() OVER (PARTITION BY lang ORDER BY freq DESC, seen) + 1 AS INTEGER), freq
  FROM ltop WHERE label NOT IN ('$KEEP', '$DELETE'))"""


ORACLES["label_vocab_by_lang"] = with_base(f"{_lang_vocab(500)} SELECT lang, label, CAST(label_id AS INTEGER) AS label_id, freq FROM vocab")
_fit_by_lang = TAGGER_FIT[TAGGER_FIT.index("tctx AS ("):].replace("LEFT JOIN vocab v USING (label)", "LEFT JOIN vocab v USING (lang, label)")
ORACLES["tagger_fit_by_lang"] = ORACLES["tagger_fit"].replace(TAGGER_FIT, f"{_lang_vocab(500)},\n{_fit_by_lang}")
ORACLES["vocab_store"] = with_base(f"""{EDITS_TRAIN},
small AS (SELECT * FROM lc ORDER BY freq DESC, first_pair, first_pos LIMIT 50),
tiny AS (SELECT label, label_id, freq FROM vocab WHERE label_id < 2 UNION ALL
         SELECT label, row_number() OVER (ORDER BY freq DESC, first_pair, first_pos) + 1, freq FROM small WHERE label NOT IN ('$KEEP', '$DELETE'))
SELECT label, CAST(label_id AS INTEGER) AS label_id, freq, unnest(['built', 'stored']) AS used, 5000 AS top_k FROM vocab
UNION ALL SELECT label, CAST(label_id AS INTEGER), freq, 'built', 50 FROM tiny""")
ORACLES["corrector_batched"] = with_base("""x AS (SELECT 1)
SELECT pair_id, CASE WHEN length(incorrect) % 7 = 0 THEN incorrect ELSE incorrect || '!' END AS prediction, length(incorrect) % 7 = 0 AS had_error
FROM splitted WHERE split = 'test'""")
_reply_steps = []
for _i, _p in enumerate(_prefixes):
    _reply_steps.append(f"rr{_i + 1} AS (SELECT pair_id, lang, source, CASE WHEN starts_with(lower(t), lower('{_p}')) "
                        f"THEN {_strip(f'substr(t, {len(_p) + 1})')} ELSE t END AS t FROM rr{_i})")
ORACLES["prompt_replies"] = with_base(f"""{RANKED},
rr0 AS (SELECT pair_id, lang, source, 'Corrected: ' || reverse({_strip("source")}) AS t FROM rs WHERE split = 'test'),
{", ".join(_reply_steps)}
SELECT pair_id, lang, coalesce(nullif(t, ''), source) AS prediction, false AS had_error FROM rr5""")
ORACLES["tagger_tag_visible"] = ORACLES["tagger_tag"].replace(
    "SELECT w.pair_id, w.pos, coalesce(v.label, '$KEEP') AS label", "SELECT w.pair_id, w.pos, CASE WHEN w.pos < 8 THEN coalesce(v.label, '$KEEP') ELSE '$KEEP' END AS label")
SPLIT_WORDS = f"""{EDITS_TRAIN},
lid AS (SELECT e.pair_id, list(CAST(coalesce(v.label_id, 0) AS INTEGER) ORDER BY e.pos) AS lids,
               list(CAST(ceil(length(e.token) / 4) AS INTEGER) ORDER BY e.pos) AS n
        FROM edits e LEFT JOIN vocab v USING (label) GROUP BY e.pair_id),
w0 AS (SELECT pair_id, lids, flatten(list_transform(n, lambda k, i: list_transform(range(k), lambda q: CAST(i - 1 AS INTEGER))))[1:126] AS b FROM lid),
w1 AS (SELECT pair_id, lids, list_concat([NULL], b, [NULL], list_transform(range(126 - len(b)), lambda q: CAST(NULL AS INTEGER))) AS wids FROM w0),
w2 AS (SELECT pair_id, wids, list_transform(wids, lambda wd, i: CASE WHEN wd IS NULL THEN -100 WHEN i > 1 AND wids[i - 1] = wd THEN -100
                                                                ELSE coalesce(lids[wd + 1], -100) END) AS labels FROM w1)"""
ORACLES["encode_split_words"] = with_base(f"""{SPLIT_WORDS}
SELECT pair_id, {_ints("labels")} AS labels, {_ints("list_transform(wids, lambda x: coalesce(x, -1))")} AS word_ids FROM w2""")
ORACLES["masked_loss"] = with_base(f"""{SPLIT_WORDS},
nb AS (SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch FROM w2),
pos AS (SELECT pair_id, unnest(labels) AS label, unnest(range(0, 128)) AS i FROM w2),
pb AS (SELECT batch, avg((((label * 7 + i) % 64 + 64) % 64) / 8.0) AS mean, count(*) AS n
       FROM pos JOIN nb USING (pair_id) WHERE label <> -100 GROUP BY batch)
SELECT round(CAST(sum(CAST(mean AS DECIMAL(24, 12))) AS DOUBLE) / count(*), 9) AS loss, count(*) AS n_batches,
       CAST(sum(n) AS BIGINT) AS n_positions FROM pb""")
ORACLES["run_config_overrides"] = with_base(f"""
d AS ({_dvals}),
sk AS (SELECT event_id, unnest(['max_len', 'freeze_encoder', 'encoder']) AS key,
              unnest([CASE WHEN user_id % 2 = 0 THEN CAST(64 + user_id % 64 AS VARCHAR) END, CAST(value > 50 AS VARCHAR), event_type]) AS sv
       FROM events WHERE user_id % 5 <> 0)
SELECT e.event_id, d.key, coalesce(sk.sv, d.dv) AS value FROM events e CROSS JOIN d LEFT JOIN sk ON sk.event_id = e.event_id AND sk.key = d.key
UNION ALL SELECT event_id, key, sv FROM sk WHERE key NOT IN (SELECT key FROM d)""")
