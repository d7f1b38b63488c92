"""SQL equivalents of the queries, written for DuckDB from the definitions."""

from __future__ import annotations

from inkspan.functions import lexicon as L
from inkspan.functions import normalize as N
from inkspan.functions.features import MTLD_THRESHOLD
from inkspan.operators.corpus import MINHASH_SEED
from inkspan.operators import evidence as E
from inkspan.operators.evaluate import LENGTHS as GRID
from inkspan.operators.evidence import FAMILY_PREFIXES
from inkspan.operators.hybrid import HIGH, LOW, MIN_SENTENCES
from inkspan.plans.queries import COEFS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs: list[str]) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


RED = r"coalesce(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')"
BL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
NORM = f"regexp_replace(translate(replace(text, chr(13) || chr(10), ' ' || chr(10)), {q(N.TABLE_FROM)}, {q(N.TABLE_TO)}), {q(N.CONTROLS)}, ' ', 'g')"
CANON = r"trim(regexp_replace(text, '[\s\x0b\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g'))"
NWORDS = f"case when {CANON} = '' then 0 else len(string_split({CANON}, ' ')) end"

DOCS = "docs as (select row_id as essay_id, text, label, prompt_name, generator, split, ell_status from train_v2_drcat_02 where text is not null)"
PARAS = rf"""
tiles as (select essay_id, unnest(regexp_extract_all({NORM}, '(?s).+?(?:' || {q(N.PARAGRAPH_BREAK)} || '|\z)', 0)) as tile, generate_subscripts(regexp_extract_all({NORM}, '(?s).+?(?:' || {q(N.PARAGRAPH_BREAK)} || '|\z)', 0), 1) as k from docs),
placed as (select essay_id, k, tile, coalesce(sum(length(tile)) over (partition by essay_id order by k rows between unbounded preceding and 1 preceding), 0) as pos0 from tiles),
paras as (select essay_id, row_number() over (partition by essay_id order by k) - 1 as para_idx, trim(tile, {BL}) as para, (pos0 + length(tile) - length(ltrim(tile, {BL})))::int as para_start from placed where trim(tile, {BL}) <> '')
"""
SENTS = rf"""
shielded as (select essay_id, para_idx, para_start, regexp_replace(regexp_replace(para, {q(N.ABBREVIATION)}, '\1\2' || chr(1), 'g'), {q(N.DECIMAL)}, '\1' || chr(1) || '\2', 'g') as p from paras),
pieces as (select essay_id, para_idx, para_start, unnest(regexp_extract_all(p, {q(N.SENTENCE)}, 0)) as tile, generate_subscripts(regexp_extract_all(p, {q(N.SENTENCE)}, 0), 1) as k from shielded),
offs as (select *, para_start + coalesce(sum(length(tile)) over (partition by essay_id, para_idx order by k rows between unbounded preceding and 1 preceding), 0) as pos0 from pieces),
cut as (select essay_id, para_idx, k, replace(trim(tile, {BL}), chr(1), '.') as text, (pos0 + length(tile) - length(ltrim(tile, {BL})))::int as start_char from offs where trim(tile, {BL}) <> ''),
sents as (select essay_id, (row_number() over (partition by essay_id order by para_idx, k) - 1)::int as sent_idx, para_idx::int as para_idx, text, start_char, (start_char + length(text))::int as end_char,
  regexp_extract_all(lower(text), {q(N.WORD)}, 0) as w from cut),
f as (select *, len(w)::int as wn, len(w) >= 5 as is_scorable, len(regexp_extract_all(text, {q(N.PUNCTUATION)}, 0)) as pn, len(w) + len(regexp_extract_all(text, {q(N.PUNCTUATION)}, 0)) as tn from sents)
"""
BASE = f"with {DOCS}, {PARAS}, {SENTS} "


def div(a: str, b: str) -> str:
    return f"(({a})::double / nullif(({b})::double, 0))"


def cnt(cond: str) -> str:
    return f"len(list_filter(w, lambda x: {cond}))"


def has(xs: list[str]) -> str:
    return f"list_contains({lst(xs)}, x)"


def occ(chars: str) -> str:
    t = "text"
    for c in chars:
        t = f"replace({t}, {q(c)}, '')"
    return f"length(text) - length({t})"


HIST = "map_values(list_histogram(w))"
GRAM2 = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
GRAM3 = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"


def rep(g: str) -> str:
    return f"case when len(w) >= 2 then (coalesce(list_sum(list_filter(map_values(list_histogram({g})), lambda c: c > 1)), 0))::double / nullif(len({g}), 0) end"


CLOSED = L.PRONOUNS + L.ADPOSITIONS + L.CONJUNCTIONS + L.SUBORDINATORS + L.DETERMINERS + L.AUXILIARIES + L.MODALS
ADJ = "(ful|less|ous|ive|able|al|ic)$"
CLAUSE = cnt(has(L.SUBORDINATORS + L.CONJUNCTIONS)) + " + 1"

FEATURES: dict[str, dict[str, str]] = {
    "structure": {"struct_token_count": "wn::double", "struct_character_count": "length(text)::double", "struct_mean_character_per_token": div("length(text)", "wn")},
    "lexical": {
        "lex_token_count": "wn::double", "lex_unique_count": "len(list_distinct(w))::double", "lex_ttr": div("len(list_distinct(w))", "wn"),
        "lex_root_ttr": "(len(list_distinct(w))::double / nullif(sqrt(wn::double), 0))",
        "lex_hapax_ratio": div(f"len(list_filter({HIST}, lambda c: c = 1))", "wn"), "lex_repeated_word_ratio": div("wn - len(list_distinct(w))", "wn"),
        "lex_mean_word_length": div("length(array_to_string(w, ''))", "wn"), "lex_stopword_ratio": div(cnt(has(L.STOPWORDS)), "tn"),
        "lex_content_word_ratio": div(cnt("not " + has(L.STOPWORDS)), "tn"), "lex_long_word_ratio": div(cnt("length(x) >= 7"), "wn"),
    },
    "punctuation": {
        **{f"punct_{k}_density": div(occ(v), "tn") for k, v in {"comma": ",", "semicolon": ";", "colon": ":", "period": ".", "question": "?", "exclamation": "!", "dash": "-", "quote": "\"'", "parenthesis": "()"}.items()},
        "punct_total_density": div("pn", "tn"), "punct_ellipsis_count": "((length(text) - length(replace(text, '...', ''))) / 3 + length(text) - length(replace(text, '…', '')))::double",
    },
    "repetition": {
        "rep_repeated_bigram_ratio": rep(GRAM2), "rep_repeated_trigram_ratio": rep(GRAM3),
        "rep_adjacent_duplicate_ratio": div("len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))", "wn"), "rep_max_word_frequency": div(f"list_max({HIST})", "wn"),
    },
    "formulaic": {
        "form_opens_with_connective": f"case when list_contains({lst(L.CONNECTIVES)}, lower(trim(regexp_extract(text, '^([^,]{{1,40}}),', 1)))) or coalesce(list_contains({lst(L.CONNECTIVES)}, w[1]), false) then 1.0::double else 0.0::double end",
        "form_has_fronted_adverbial": f"case when coalesce(list_contains({lst(L.ADPOSITIONS + L.SUBORDINATORS)}, w[1]) or regexp_matches(w[1], 'ly$'), false) and regexp_matches(text, '^[^,]{{1,60}},') then 1.0::double else 0.0::double end",
        "form_connective_density": div(cnt(has([x for x in L.CONNECTIVES if " " not in x])), "wn"), "form_hedge_density": div(cnt(has(L.HEDGES + L.MODALS)), "wn"),
        "form_nominalization_density": div(cnt(f"length(x) >= 7 and regexp_matches(x, '({'|'.join(L.NOMINAL_SUFFIXES)})$')"), "wn"),
        "form_specificity_density": div(r"len(regexp_extract_all(text, '\s\p{Lu}[\p{L}\p{N}]*|[0-9]+', 0))", "wn"),
    },
    "syntax": {
        "syn_pron_ratio": div(cnt(has(L.PRONOUNS)), "wn"), "syn_adp_ratio": div(cnt(has(L.ADPOSITIONS)), "wn"), "syn_cconj_ratio": div(cnt(has(L.CONJUNCTIONS)), "wn"),
        "syn_adv_ratio": div(cnt("regexp_matches(x, 'ly$') and length(x) > 3"), "wn"), "syn_verb_ratio": div(cnt(f"{has(L.AUXILIARIES + L.MODALS)} or (regexp_matches(x, '(ed|ing)$') and length(x) > 4)"), "wn"),
        "syn_adj_ratio": div(cnt(f"regexp_matches(x, '{ADJ}') and length(x) > 4"), "wn"),
        "syn_noun_ratio": div(cnt(f"not {has(CLOSED)} and not regexp_matches(x, '(ly|ed|ing|ful|less|ous|ive|able|al|ic)$') and regexp_matches(x, '^\\p{{L}}')"), "wn"),
        "syn_propn_ratio": div(r"len(regexp_extract_all(text, '\s\p{Lu}[\p{L}]*', 0))", "wn"), "syn_first_person_ratio": div(cnt(has(L.FIRST_PERSON)), "wn"),
        "syn_clause_count": f"({CLAUSE})::double", "syn_clauses_per_token": div(CLAUSE, "wn"),
        "syn_max_dependency_depth": "null::double", "syn_mean_dependency_depth": "null::double", "syn_mean_branching_factor": "null::double",
    },
}
ALL = {k: v for fam in FEATURES.values() for k, v in fam.items()}


def _family(name: str) -> str:
    return BASE + "select essay_id, sent_idx, is_scorable, " + ", ".join(f"round({v}, 6) as {k}" for k, v in FEATURES[name].items()) + " from f"


LENGTHS = "steps as (select essay_id, wn, abs(wn - lag(wn) over (partition by essay_id order by sent_idx)) as step from f)"
RHYTHM = """r as (select essay_id, count(*) as n, avg(wn) as m, stddev_pop(wn) as sd, avg(step) as msd from steps group by 1)"""
RHYTHM_COLS = """round(m, 6) as rhythm_mean_length, round(case when n >= 4 then sd end, 6) as rhythm_length_std, round(case when n >= 4 then sd / nullif(m, 0) end, 6) as rhythm_coefficient_of_variation,
 round(case when n >= 4 then (sd - m) / nullif(sd + m, 0) end, 6) as rhythm_burstiness, round(case when n >= 4 then msd end, 6) as rhythm_mean_successive_difference, round(case when n >= 4 then msd / nullif(m, 0) end, 6) as rhythm_normalized_successive_difference"""
SUMMARISED = ("lex_ttr", "lex_stopword_ratio", "syn_first_person_ratio", "syn_clauses_per_token", "punct_total_density", "punct_comma_density", "form_hedge_density", "form_nominalization_density", "form_specificity_density")

SCORES = """ev as (select row_id, sum(contribution) as z from signal_evidence group by 1),
sc as (select t.row_id as essay_id, label, generator, prompt_name, ell_status, split, round(1 / (1 + exp(-z)), 4) as p from train_v2_drcat_02 t join ev using (row_id) where label is not null)"""
SS = """ss as (select row_id, sentence_index, label, prompt_name, is_scorable, case when is_scorable and isfinite(v) then v end as score from (select *, feature_values['lex_ttr'] as v from sentence_features))"""
WIDE_NAMES = ("lex_ttr", "lex_mtld", "punct_comma_density", "pred_cross_entropy", "form_hedge_density", "rep_repeated_word_ratio")
WIDE = "wide as (select row_id, sentence_index, label, is_scorable, " + ", ".join(f"case when isfinite(feature_values['{n}']) then feature_values['{n}'] end as {n}" for n in WIDE_NAMES) + " from sentence_features)"
FAM = "case " + " ".join(f"when starts_with(ff, {q(p)}) then {q(n)}" for p, n in FAMILY_PREFIXES) + " else 'Other' end"
STRIP = "regexp_replace(regexp_replace(measured_feature, '__missing$', ''), '^(docmean_|docstd_|doc_)', '')"
DESCRIBED = """case when {z} is null then case when contribution > 0 then 'above typical' else 'below typical' end when abs({z}) >= 2 then 'far ' || case when {z} > 0 then 'above' else 'below' end || ' the human average'
            when abs({z}) >= 1 then 'noticeably ' || case when {z} > 0 then 'above' else 'below' end || ' the human average' else 'close to the human average' end"""
SIGNALS = f"""fe as (select row_id, measured_feature, contribution, case when isfinite(z_score) then z_score else {E.NO_SCORE} end as zz, {FAM} as fam from (select *, {STRIP} as ff from signal_evidence where contribution is not null and not isnan(contribution))),
sg as (select row_id, fam, round(sum(contribution), 6) as contribution, min(struct_pack(a := -abs(contribution), f := measured_feature, z := zz)) as t from fe group by 1, 2),
sz as (select *, case when t.z < {E.NO_SCORE} then t.z end as z_score from sg where abs(contribution) >= 0.05),
sr as (select row_id, fam as family, contribution, case when contribution > 0 then 'machine' else 'human' end as direction, regexp_replace(t.f, '__missing$', '') as strongest_feature, z_score, {DESCRIBED.format(z="z_score")} as descriptor,
 row_number() over (partition by row_id order by abs(contribution) desc, fam) as rank from sz)"""
_COEF_COLS = sorted({k.removesuffix("__missing") for k in COEFS})
STATS = f"with {WIDE}, tr as (select * from wide where is_scorable and label is not null), long as (unpivot (select {', '.join(_COEF_COLS)} from tr) on {', '.join(_COEF_COLS)} into name feature value value), tot as (select count(*) as t from tr), " + """
kept as (select feature, quantile_cont(value, 0.5) as median, count(*) as n, any_value(t) as t from long, tot group by feature having count(*) >= 0.3 * any_value(t) and var_samp(value) >= 1e-10),
st as (select feature, median, (sum(value) + (any_value(t) - count(*)) * median) / any_value(t) as mean, n < t as has_indicator, any_value(t) as t from long join kept using (feature) group by feature, median, n, t),
sd as (select feature, median, mean, sqrt((sum((value - mean) ** 2) + (any_value(t) - count(*)) * (any_value(median) - any_value(mean)) ** 2) / any_value(t)) as sd0, has_indicator from long join st using (feature) group by feature, median, mean, has_indicator),
stats as (select feature, median, mean, case when sd0 > 0 then sd0 else 1.0 end as sd, has_indicator from sd)"""
_TERMS = f"""
cells as ({" union all ".join(f"select row_id, sentence_index, '{c}' as feature, {c} as value from wide" for c in _COEF_COLS)}),
coef(feature, b) as (values {', '.join(f"('{k}', {v}::double)" for k, v in COEFS.items())}),
terms as (
 select c.row_id, c.sentence_index, c.feature, co.b * (coalesce(c.value, s.median) - s.mean) / s.sd as x from cells c join stats s using (feature) join coef co on co.feature = c.feature
 union all select c.row_id, c.sentence_index, c.feature || '__missing', co.b * (c.value is null)::int from cells c join stats s using (feature) join coef co on co.feature = c.feature || '__missing' where s.has_indicator)"""
_LOGIT = "-0.1" + "".join(
    f" + {v} * coalesce((({c} is null)::int * (select has_indicator::int from stats where feature = '{c}')), 0)" if k.endswith("__missing")
    else f" + {v} * coalesce((select (coalesce({c}, median) - mean) / sd from stats where feature = '{c}'), 0)"
    for k, v in COEFS.items() for c in [k.removesuffix("__missing")])
ORDER = "('0x' || substring(md5(row_id::varchar || ':{0}'), 1, 8))::bigint".format(MINHASH_SEED)
Z = 1.96


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::double / {n})"
    half = f"{Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z / 4} / ({n}::double * {n}))"
    den = f"(1 + {Z * Z} / {n})"
    mid = f"({p} + {Z * Z / 2} / {n})"
    return f"greatest(0.0, ({mid} - {half}) / {den})", f"least(1.0, ({mid} + {half}) / {den})"


def rates(where: str, by: str) -> str:
    lo, hi = wilson("flagged", "n")
    return f"""with {SCORES}, g as (select {by}, case when label = 1 then 'machine' else 'human' end as kind, count(*) as n, count(*) filter (p >= 0.5) as flagged, avg(p) as mp from sc where {where} group by 1, 2)
    select {by}, kind, n, flagged, round(flagged::double / n, 6) as rate, round({lo}, 6) as ci_low, round({hi}, 6) as ci_high, round(mp, 6) as mean_p from g"""


BINS = " + ".join(f"(p >= {i / 10!r})::int" for i in range(1, 10))
RELIABILITY = f"with {SCORES}, rel as (select {BINS} as bin, count(*) as n, avg(p) as mean_predicted, avg(label) as observed from sc where p between 0 and 1 group by 1) "
AUC = """select {by} round(sum(pp * (below + qq / 2.0)) / nullif((sum(pp) * sum(qq))::double, 0), 6) as auc from (
 select {by} pp, qq, coalesce(sum(qq) over ({part} order by v rows between unbounded preceding and 1 preceding), 0) as below from (
  select {by} {v} as v, count(*) filter (label = 1) as pp, count(*) filter (label <> 1) as qq from {src} where label is not null and {v} is not null group by all)) {grp}"""
LM = f"""{BASE}, human as (select essay_id from docs where label = 0 and split = 'train'),
vocab as (select w1 as w, n from (select unnest(w) as w1, count(*) as n from f where essay_id in (select essay_id from human) group by 1) order by n desc, w limit 50000),
tok0 as (select essay_id, sent_idx, unnest(w) as raw, generate_subscripts(w, 1) as pos from f),
tok1 as (select essay_id, sent_idx, pos, coalesce(v.w, '<unk>') as w from tok0 left join vocab v on v.w = raw),
tok as (select *, lag(w, 1, '<s>') over o as w1, lag(w, 2, '<s>') over o as w2 from tok1 window o as (partition by essay_id, sent_idx order by pos)),
fitt as (select * from tok where essay_id in (select essay_id from human)),
uni as (select w, count(*) as n from fitt group by 1), bi as (select w1, w, count(*) as n from fitt group by 1, 2), c1 as (select w1, count(*) as n from fitt group by 1),
tri as (select w2, w1, w, count(*) as n from fitt group by 1, 2, 3 having count(*) >= 2), c2 as (select w2, w1, count(*) as n from fitt group by 1, 2)"""
KEY = rf"sha256(lower({CANON}))"
LM_BITS = """, t as (select sum(n)::double as total from uni), vs as (select count(*)::double as v from vocab),
h as (select tok.essay_id, tok.sent_idx, avg(-log2(0.5 * coalesce(tri.n::double / c2.n, 0) + 0.3 * coalesce(bi.n::double / c1.n, 0) + 0.2 * (coalesce(uni.n, 0) + 0.4) / (total + 0.4 * (v + 1)))) as h
 from tok cross join t cross join vs left join uni on uni.w = tok.w left join bi on bi.w1 = tok.w1 and bi.w = tok.w left join c1 on c1.w1 = tok.w1
 left join tri on tri.w2 = tok.w2 and tri.w1 = tok.w1 and tri.w = tok.w left join c2 on c2.w2 = tok.w2 and c2.w1 = tok.w1 group by 1, 2),
pred as (select row_id as essay_id, label, split, round(m, 4) as docmean_pred_cross_entropy, round(sd, 4) as docstd_pred_cross_entropy from train_v2_drcat_02
 left join (select essay_id, avg(h) as m, case when count(*) > 1 then stddev_pop(h) end as sd from h group by 1) p on p.essay_id = row_id)"""
MANIFEST = "(select * from split_manifest order by created_at desc, manifest_id desc limit 1)"


def mtld(w: str) -> str:
    """One direction: the state counts factors, the types and the number of words since the last one."""
    seen = "case when list_contains(a.s, b.s[1]) then a.s else list_append(a.s, b.s[1]) end"
    step = f"case when len({seen})::double / (a.n + 1) <= {MTLD_THRESHOLD}::double then {{'f': a.f + 1, 's': []::varchar[], 'n': 0}} else {{'f': a.f, 's': {seen}, 'n': a.n + 1}} end"
    state = f"list_reduce(list_transform({w}, lambda x: {{'f': 0::double, 's': [x], 'n': 1}}), lambda a, b: {step}, {{'f': 0::double, 's': []::varchar[], 'n': 0}})"
    return f"(select len({w}) / greatest(st.f + case when st.n > 0 then (1 - len(st.s)::double / st.n) / (1 - {MTLD_THRESHOLD}::double) else 0 end, 1.0) from (select {state} as st))"


def both_ways(w: str) -> str:
    return f"case when len({w}) >= 10 then ({mtld(w)} + {mtld(f'list_reverse({w})')}) / 2 end"


def ranked_groups(where: str, source: str = "train_v2_drcat_02") -> str:
    """``sized``: groups by size, largest first, ties by name, numbered from 1."""
    return f"sized as (select prompt_name, count(*) as n, row_number() over (order by count(*) desc, prompt_name) as i from {source} where prompt_name is not null and {where} group by 1)"


# Each group to the lightest of five folds, the lowest on ties.
FOLDS = """walk as (select 0::bigint as i, null::varchar as prompt_name, 0::bigint as n, -1::bigint as fold, list_transform(range(least(5, greatest(1, (select count(*) from sized)))), lambda x: 0::bigint) as load
 union all select s.i, s.prompt_name, s.n, list_position(load, list_min(load)) - 1, list_transform(load, lambda y, j: case when j = list_position(load, list_min(load)) then y + s.n else y end)
 from walk join sized s on s.i = walk.i + 1), folds as (select prompt_name, fold::int as fold, n from walk where i > 0)"""


def oracle_sql() -> dict[str, str]:
    doc = [f"round(avg({k}), 6) as docmean_{k}, round(case when count({k}) > 1 then stddev_pop({k}) end, 6) as docstd_{k}" for k in SUMMARISED]
    one = "count(*) filter (label = 1 and p >= 0.5) as tp, count(*) filter (label <> 1 and p >= 0.5) as fp, count(*) filter (label <> 1 and p < 0.5) as tn, count(*) filter (label = 1 and p < 0.5) as fn"
    out = {
        "proj_canonical": f"""select row_id as essay_id, substring(sha256({CANON}), 1, 16) as content_id, ({NWORDS})::int as n_words, length(text)::int as n_chars, nullif(trim(ell_status), '') as ell_status,
            ({NWORDS}) between 50 and 1000 as in_band, length(text) between 1 and 100000 and {CANON} <> '' as accepted from train_v2_drcat_02 where text is not null""",
        "n_normalized": f"select row_id as essay_id, sha256({NORM}) as digest, length({NORM}) = length(text) as same_length from train_v2_drcat_02 where text is not null",
        "n_paragraphs": f"with {DOCS}, {PARAS} select essay_id, para_idx::int as para_idx, para, para_start from paras",
        "n_sentences": BASE + "select essay_id, sent_idx, para_idx, text, start_char, end_char, wn as token_count, is_scorable from f",
        "n_first_sentences": BASE + "select essay_id, string_agg(text, ' ' order by sent_idx) as text from f where sent_idx < 3 group by 1 having count(*) = 3",
        "n_retokenized": BASE + f", n as (select essay_id, {NORM} as n from docs) select essay_id, sent_idx, len(regexp_extract_all(lower(substring(n, start_char + 1, end_char - start_char)), {q(N.WORD)}, 0))::int as n_words, md5(substring(n, start_char + 1, end_char - start_char)) as digest from f join n using (essay_id)",
        **{f"f_{name}": _family(name) for name in FEATURES},
        "c_context": BASE + f""", b as (select *, count(*) over d as ns, avg(wn) over d as m, stddev_pop(wn) over d as sd, count(*) over (partition by essay_id, array_to_string(w[1:4], ' ')) as same from f window d as (partition by essay_id)),
            v as (select essay_id, sent_idx, avg((k > 1)::int) as e from (select *, count(*) over (partition by essay_id, x) as k from (select essay_id, sent_idx, unnest(list_distinct(w)) as x from f)) group by 1, 2),
            g as (select essay_id, sent_idx, avg((k > 1)::int) as e from (select *, count(*) over (partition by essay_id, x) as k from (select essay_id, sent_idx, unnest(list_distinct({GRAM2})) as x from f)) group by 1, 2)
            select b.essay_id, b.sent_idx, round((wn - m) / nullif(sd, 0), 6) as structctx_length_z_score, round(wn / nullif(m, 0), 6) as structctx_length_ratio,
            round(case when ns > 1 then case when wn = 0 then 0.0::double else (same - 1)::double / (ns - 1) end end, 6) as repctx_template_echo,
            round(case when ns > 1 then v.e end, 6) as repctx_vocabulary_echo, round(case when ns > 1 then g.e end, 6) as repctx_bigram_echo
            from b left join v using (essay_id, sent_idx) left join g using (essay_id, sent_idx)""",
        "w_rhythm": BASE + f", {LENGTHS}, {RHYTHM} select essay_id, {RHYTHM_COLS} from r",
        "w_windows": BASE + """select essay_id, start_idx, end_idx, round(m, 6) as mean_length, round(sd, 6) as length_std from (select essay_id, sent_idx as start_idx, last_value(sent_idx) over o as end_idx, count(*) over o as k, avg(wn) over o as m, stddev_pop(wn) over o as sd
            from f window o as (partition by essay_id order by sent_idx rows between current row and 3 following)) where k = 4""",
        "w_passages": f"""with {SS}, x as (select row_id, sentence_index, max(score) as score from ss group by 1, 2) select row_id, start_idx, end_idx, round(a, 6) as score from (
            select row_id, sentence_index as start_idx, last_value(sentence_index) over o as end_idx, count(*) over o as k, avg(score) over o as a from x window o as (partition by row_id order by sentence_index rows between current row and 3 following)) where k = 4 and a is not null""",
        "g_document_features": BASE + f""", {LENGTHS}, {RHYTHM}, sf as (select essay_id, w, wn, {', '.join(f'{ALL[k]} as {k}' for k in SUMMARISED)} from f),
            dd as (select essay_id, sum(wn)::double as doc_token_count, len(list_distinct(flatten(list(w))))::double as doc_unique_count, count(*)::double as doc_sentence_count, {', '.join(doc)} from sf group by 1)
            select dd.*, round(doc_unique_count / nullif(doc_token_count, 0), 6) as doc_ttr, {RHYTHM_COLS} from dd join r using (essay_id)""",
        "lm_trigrams": LM + " select w2, w1, w, n from tri",
        "lm_scores": LM + """, t as (select sum(n)::double as total from uni), vs as (select count(*)::double as v from vocab)
            select essay_id, sent_idx, round(avg(bits), 4) as pred_cross_entropy, round(pow(2, avg(bits)), 4) as pred_perplexity from (
             select tok.essay_id, tok.sent_idx, -log2(0.5 * coalesce(tri.n::double / c2.n, 0) + 0.3 * coalesce(bi.n::double / c1.n, 0) + 0.2 * (coalesce(uni.n, 0) + 0.4) / (total + 0.4 * (v + 1))) as bits
             from tok cross join t cross join vs left join uni on uni.w = tok.w left join bi on bi.w1 = tok.w1 and bi.w = tok.w left join c1 on c1.w1 = tok.w1
             left join tri on tri.w2 = tok.w2 and tri.w1 = tok.w1 and tri.w = tok.w left join c2 on c2.w2 = tok.w2 and c2.w1 = tok.w1) group by 1, 2""",
        "d_exact": f"select row_id as essay_id, min(row_id) over (partition by {KEY}) as kept_id from train_v2_drcat_02 where text is not null",
        "s_cells": f"select row_id as essay_id, prompt_name, label from (select *, row_number() over (partition by prompt_name, label order by {ORDER}, row_id) as r from train_v2_drcat_02) where r <= 5",
        "s_matched": f"""with t as (select * from train_v2_drcat_02 where split = 'test'), n as (select prompt_name, count(*) filter (ell_status = 'Yes') as y, count(*) filter (ell_status = 'No') as x from t group by 1)
            select prompt_name, ell_status, essay_id from (select prompt_name, ell_status, row_id as essay_id, row_number() over (partition by prompt_name, ell_status order by {ORDER}, row_id) as r from t where ell_status in ('Yes', 'No')) join n using (prompt_name) where r <= least(x, y)""",
        "s_hash": "select sha256(string_agg(prompt_name || chr(9) || split, chr(10) order by prompt_name || chr(9) || split)) as split_hash from (select prompt_name, min(split) as split from train_v2_drcat_02 where split is not null and prompt_name is not null group by 1)",
        "s_validation": """with g as (select * from train_v2_drcat_02 where split is not null), k as (select prompt_name, count(distinct split) as k from g group by 1),
            per as (select a.split, count(*) filter (k.k > 1) as shared_groups from (select distinct prompt_name, split from g) a join k on a.prompt_name is not distinct from k.prompt_name group by 1)
            select split, count(*) as n_rows, count(distinct prompt_name) as n_groups, count(distinct label) > 1 as both_classes, count(distinct case when label = 1 then generator end) as machine_generators, any_value(shared_groups) as shared_groups from g join per using (split) group by 1""",
        "s_counts": "select split, generator, count(*) as n, count(distinct prompt_name) as n_prompts from train_v2_drcat_02 group by 1, 2",
        "m_statistics": STATS + " select feature, round(median, 5) as median, round(mean, 5) as mean, round(sd, 5) as sd, has_indicator from stats",
        "m_linear": STATS + f" select row_id, sentence_index, round(1 / (1 + exp(-({_LOGIT}))), 6) as p from wide",
        "m_contributions": STATS + "," + _TERMS + " select row_id, feature, round(sum(x), 5) as contribution from terms group by 1, 2",
        "a_score_summary": f"""with {SS}, g as (select row_id, avg(score) as m, stddev_pop(score) as sd, min(score) as lo, max(score) as hi, quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9]) as qs, avg((score >= 0.6)::int) as hr, count(*) as n from ss where score is not null group by 1),
            t as (select row_id, avg(score) as top from ss join g using (row_id) where score >= qs[4] group by 1)
            select row_id, round(m, 6) as sentscore_mean, round(sd, 6) as sentscore_std, round(lo, 6) as sentscore_min, round(hi, 6) as sentscore_max, round(qs[1], 6) as sentscore_q10, round(qs[2], 6) as sentscore_q25, round(qs[3], 6) as sentscore_q50, round(qs[4], 6) as sentscore_q75, round(qs[5], 6) as sentscore_q90,
            round(hr, 6) as sentscore_high_risk_fraction, n as sentscore_scorable_count, round(hi - lo, 6) as sentscore_range, round(top, 6) as sentscore_top_quartile_mean from g join t using (row_id)""",
        "a_confidence": f"""with {SS}, g as (select row_id, count(score) as n, count(*) as t, coalesce(stddev_pop(score), 0) as sd from ss group by 1), c as (select row_id, case when n = 0 then 0.0::double else least(1.0, n / 12.0::double) * n / t * (1 - least(1.0, 2 * sd)) end as c from g)
            select row_id, round(c, 6) as confidence, case when c <= 0.34 then 'low' when c >= 0.67 then 'high' else 'medium' end as confidence_band from c""",
        "a_metrics": f"""with {SCORES}, g as (select {one}, avg((p - label) ** 2) as b from sc), h as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) as pr, coalesce(tp::double / nullif(tp + fn, 0), 0) as rc from g)
            select tp, fp, tn, fn, round((tp + tn)::double / nullif(tp + fp + tn + fn, 0), 6) as accuracy, round(pr, 6) as precision, round(rc, 6) as recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) as f1,
            round(fp::double / nullif(fp + tn, 0), 6) as fpr, round(fn::double / nullif(fn + tp, 0), 6) as fnr, round(case when tp + fn > 0 and fp + tn > 0 then b end, 6) as brier from h""",
        "a_auc": f"with {SCORES} " + AUC.format(by="", part="", v="p", src="sc", grp=""),
        "a_separation": f"with {WIDE}, long as ({" union all ".join(f"select label, '{c}' as feature, {c} as value from wide" for c in WIDE_NAMES)}), au as (" + AUC.format(by="feature,", part="partition by feature", v="value", src="long", grp="group by feature") + """),
            d as (select feature, count(value) filter (label = 1) as n1, count(value) filter (label = 0) as n0, avg(value) filter (label = 1) as m1, avg(value) filter (label = 0) as m0, var_samp(value) filter (label = 1) as v1, var_samp(value) filter (label = 0) as v0, count(value) as k, count(*) as t from long where label is not null group by 1)
            select feature, auc, round(abs(auc - 0.5), 6) as separation, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) as cohens_d, round(m1, 6) as machine_mean, round(m0, 6) as human_mean, round(k::double / t, 6) as defined_fraction from au join d using (feature) where k::double / t >= 0.5""",
        "a_reliability": RELIABILITY + "select bin, n, round(mean_predicted, 6) as mean_predicted, round(observed, 6) as observed from rel",
        "a_ece": RELIABILITY + "select round(sum(n * abs(mean_predicted - observed)) / sum(n)::double, 6) as ece from rel",
        "a_generator_rates": rates("true", "generator"),
        "a_fairness": rates("label = 0 and ell_status is not null", "ell_status"),
        "a_pivot": f"with {SCORES} select split, round(avg(p) filter (label = 0), 6) as human, round(avg(p) filter (label = 1), 6) as machine from sc group by 1",
        "a_buckets": f"with {SCORES} select case when p <= 0.35 then 'a' when p <= 0.45 then 'b' when p <= 0.55 then 'c' else 'd' end as bucket, count(*) as n, count(*) filter (p >= 0.5) as detected, round(avg(p), 6) as mean_p from sc group by 1",
        "a_reference": f"with {WIDE}, long as (unpivot (select lex_ttr, lex_mtld, pred_cross_entropy, punct_comma_density from wide where label = 0 and is_scorable) on lex_ttr, lex_mtld, pred_cross_entropy, punct_comma_density into name feature value value) select feature, round(avg(value), 5) as mean, round(stddev_pop(value), 5) as sd from long group by 1",
        "a_bands": f"with {SS}, b as (select *, round_even(score * 100, 0) as s from ss) select case when s is null then 'not_scored' when s <= 35 then 'low' when s >= 65 then 'high' else 'medium' end as band, count(*) as n, round(avg(score), 6) as mean_score from b group by 1",
        "a_failures": f"with {SCORES} select essay_id, label, p, round(abs(p - label), 4) as distance from sc where (p >= 0.5) <> (label = 1) order by distance desc, essay_id limit 3",
        "e_signals": f"with {SIGNALS} select row_id, family, contribution, direction, strongest_feature, z_score, descriptor, rank::int as rank from sr where rank <= 6",
        "e_described": f"""with ref as (select measured_feature, avg(measured_value) filter (isfinite(measured_value)) as m, stddev_pop(measured_value) filter (isfinite(measured_value)) as sd from signal_evidence where direction = 'human' group by 1),
            j as (select evidence_id, contribution, {STRIP} as ff, round(case when isfinite(measured_value) then (measured_value - m) / nullif(sd, 0) end, 3) as z from signal_evidence left join ref using (measured_feature))
            select evidence_id, {FAM} as family, z, case when z is null then case when contribution > 0 then 'above typical' else 'below typical' end when abs(z) >= 2 then 'far ' || case when z > 0 then 'above' else 'below' end || ' the human average'
            when abs(z) >= 1 then 'noticeably ' || case when z > 0 then 'above' else 'below' end || ' the human average' else 'close to the human average' end as descriptor from j""",
        "e_verdicts": f"""with {SCORES}, n as (select row_id as essay_id, count(*) filter (is_scorable) as n from sentence_features group by 1), j as (select essay_id, coalesce(n, 0) as n, round_even(p * 100, 0)::int as risk from sc left join n using (essay_id))
            select essay_id, risk, case when risk <= 35 then 'low' when risk >= 65 then 'high' else 'medium' end as band, case when n < 5 then 'insufficient_text' when risk <= 35 then 'likely_human' when n < 12 then 'mixed_signals' when risk >= 65 then 'likely_machine' else 'mixed_signals' end as assessment from j""",
        "e_explanations": f"""with {SCORES}, {SIGNALS}, want as (select essay_id, case when p >= 0.5 then 'machine' else 'human' end as want from sc),
            l as (select essay_id, want, case when want = 'machine' then {q(E.VERDICTS['machine'])} else {q(E.VERDICTS['human'])} end as v, coalesce(list({{'f': lower(family), 'd': descriptor}} order by rank) filter (direction = want), []) as yes,
              coalesce(list({{'f': lower(family), 'd': descriptor}} order by rank) filter (direction <> want), []) as no from want left join (select * from sr where rank <= 6) s on s.row_id = essay_id group by 1, 2)
            select essay_id, case when len(yes) + len(no) = 0 then {q(E.NOTHING)} else concat_ws(' ', case when len(yes) > 0 then format({q(E.DRIVEN)}, v, yes[1].f, yes[1].d) else format({q(E.UNDRIVEN)}, v) end,
            case when len(yes) > 1 then format({q(E.ALSO)}, array_to_string(list_transform(yes[2:3], lambda x: x.f || ' (' || x.d || ')'), ', ')) end, case when len(no) > 0 then format({q(E.AGAINST)}, no[1].f, no[1].d) end) end as explanation from l""",
        "j_overlap": BASE + """, spans as (select distinct row_id as essay_id, start_char as s, end_char as e from sentence where is_scorable), ours as (select * from f where essay_id in (select row_id from sentence)),
            o as (select ours.essay_id, sent_idx, any_value(start_char) as a, any_value(end_char) as b, coalesce(sum(greatest(0, least(end_char, e) - greatest(start_char, s))), 0) as o from ours left join spans using (essay_id) group by 1, 2)
            select essay_id, sent_idx, round(coalesce(o::double / nullif(b - a, 0), 0), 6) as overlap, coalesce(o::double / nullif(b - a, 0), 0) > 0.5 as is_rewritten from o""",
        "f_mtld": BASE + f"select essay_id, sent_idx, round({both_ways('w')}, 6) as lex_mtld from f",
        "g_document_mtld": BASE + f", g as (select essay_id, flatten(list(w order by sent_idx)) as w from f group by 1) select essay_id, round({both_ways('w')}, 6) as doc_mtld from g",
        "h_rebuilt": BASE + f""", s as (select essay_id, sent_idx, text, count(*) over (partition by essay_id) as n from f where essay_id in (select essay_id from docs where label = 0 and split in ('validation', 'test'))),
            k as (select *, greatest(1, round_even(n * ({LOW}::double + {HIGH - LOW!r}::double * ((('0x' || substring(md5(essay_id::varchar || ':{MINHASH_SEED}'), 1, 8))::bigint % 1000) / 1000.0::double)), 0)::int) as k from s where n >= {MIN_SENTENCES}),
            c as (select *, row_number() over (partition by essay_id order by md5(essay_id::varchar || ':' || sent_idx::varchar || ':{MINHASH_SEED}'), sent_idx) <= k as use from k),
            t as (select essay_id, sent_idx, case when use then 'In other words: ' || text else text end as text, use as is_rewritten from c),
            o as (select *, coalesce(sum(length(text) + 1) over (partition by essay_id order by sent_idx rows between unbounded preceding and 1 preceding), 0)::int as start_char from t)
            select essay_id, sent_idx, start_char, (start_char + length(text))::int as end_char, is_rewritten, text from o""",
        "s_groups": f"""with recursive {ranked_groups('true')}, total as (select sum(n)::double as t from sized),
            walk as (select 0::bigint as i, null::varchar as prompt_name, 0::bigint as n, null::varchar as split, 0::double as a, 0::double as b, 0::double as c
             union all select i, prompt_name, n, pick, a + case when pick = 'train' then n else 0 end, b + case when pick = 'validation' then n else 0 end, c + case when pick = 'test' then n else 0 end
             from (select s.i, s.prompt_name, s.n, a, b, c, case when 0.7::double * t - a >= 0.15::double * t - b and 0.7::double * t - a >= 0.15::double * t - c then 'train' when 0.15::double * t - b >= 0.15::double * t - c then 'validation' else 'test' end as pick
              from walk join sized s on s.i = walk.i + 1 cross join total))
            select prompt_name, split, n from walk where i > 0""",
        "s_folds": f"with recursive {ranked_groups("split = 'train'")}, {FOLDS} select prompt_name, fold, n from folds",
        "lm_out_of_fold": BASE.replace("with ", "with recursive ", 1) + f""", {ranked_groups("split = 'train'")}, {FOLDS}, e as (select essay_id, fold, label from docs join folds using (prompt_name) where split = 'train'),
            tok0 as (select f.essay_id, sent_idx, fold, label, unnest(w) as raw, generate_subscripts(w, 1) as pos from f join e using (essay_id)), ks as (select distinct fold as k from folds),
            vocab as (select k, raw as word from (select k, raw, row_number() over (partition by k order by count(*) desc, raw) as r from tok0, ks where fold <> k and label = 0 group by 1, 2) where r <= 50000),
            tok1 as (select ks.k, essay_id, sent_idx, fold, label, pos, coalesce(word, '<unk>') as w from tok0 join ks on fold = ks.k or label = 0 left join vocab on vocab.k = ks.k and word = raw),
            tok as (select *, lag(w, 1, '<s>') over o as w1, lag(w, 2, '<s>') over o as w2 from tok1 window o as (partition by k, essay_id, sent_idx order by pos)), fitt as (select * from tok where fold <> k),
            uni as (select k, w, count(*) as n from fitt group by 1, 2), bi as (select k, w1, w, count(*) as n from fitt group by 1, 2, 3), c1 as (select k, w1, count(*) as n from fitt group by 1, 2),
            tri as (select k, w2, w1, w, count(*) as n from fitt group by 1, 2, 3, 4 having count(*) >= 2), c2 as (select k, w2, w1, count(*) as n from fitt group by 1, 2, 3),
            t as (select k, sum(n)::double as total from uni group by 1), vs as (select k, count(*)::double as v from vocab group by 1)
            select essay_id, sent_idx, round(h, 4) as pred_cross_entropy, round(pow(2, h), 4) as pred_perplexity from (select s.essay_id, s.sent_idx,
             avg(-log2(0.5 * coalesce(tri.n::double / c2.n, 0) + 0.3 * coalesce(bi.n::double / c1.n, 0) + 0.2 * (coalesce(uni.n, 0) + 0.4) / (total + 0.4 * (v + 1)))) as h
             from tok s join t on t.k = s.k join vs on vs.k = s.k left join uni on uni.k = s.k and uni.w = s.w left join bi on bi.k = s.k and bi.w1 = s.w1 and bi.w = s.w left join c1 on c1.k = s.k and c1.w1 = s.w1
             left join tri on tri.k = s.k and tri.w2 = s.w2 and tri.w1 = s.w1 and tri.w = s.w left join c2 on c2.k = s.k and c2.w2 = s.w2 and c2.w1 = s.w1 where s.fold = s.k group by 1, 2)""",
        "j_metadata": rf"""with first as (select sha256({CANON}) as k, min({{'r': row_id, 'e': ell_status, 'g': grade_level}}) as m from train_v2_drcat_02 where text is not null group by 1)
            select doc_id, nullif(trim(m.e), '') as ell_status, m.g as grade_level from (select doc_id, sha256({CANON}) as k from documents) left join first using (k)""",
        "j_prompt_split": f"with m as (select unnest(map_keys(group_assignment)) as prompt_name, unnest(map_values(group_assignment)) as assigned from {MANIFEST}) select row_id as essay_id, assigned from train_v2_drcat_02 left join m using (prompt_name)",
        "j_predicted": LM + LM_BITS + " select * from pred",
        "a_pivot_entropy": LM + LM_BITS + " select split, round(avg(docmean_pred_cross_entropy) filter (label = 0), 3) as human, round(avg(docmean_pred_cross_entropy) filter (label = 1), 3) as machine from pred group by 1",
        "j_rest": f"select row_id as essay_id from (select row_id, row_number() over (partition by prompt_name, label order by {ORDER}, row_id) as r from train_v2_drcat_02) where r > 5",
        "j_held_out": rf"""with m as (select unnest(map_keys(group_assignment)) as name, unnest(map_values(group_assignment)) as should from {MANIFEST})
            select row_id as essay_id from train_v2_drcat_02 where {RED.format(c='prompt_name')} <> '' and {RED.format(c='prompt_name')} in (select {RED.format(c='name')} from m where should in ('validation', 'test'))""",
        "m_top_contributions": STATS + "," + _TERMS + """, c as (select row_id, feature, round(sum(x), 5) as contribution from terms group by 1, 2)
            select row_id, feature, contribution, rank::int as rank from (select *, row_number() over (partition by row_id order by abs(contribution) desc, feature) as rank from c) where rank <= 3""",
        "a_reference_train": f"with {WIDE}, long as (unpivot (select {', '.join(WIDE_NAMES)} from wide where is_scorable and row_id in (select row_id from train_v2_drcat_02 where split = 'train' and label = 0)) on {', '.join(WIDE_NAMES)} into name feature value value) select feature, round(avg(value), 5) as mean, round(stddev_pop(value), 5) as sd from long group by 1",
        "a_document_summary": f"""with {SS}, b as (select *, round_even(score * 100, 0) as s from ss) select row_id, count(*) as sentence_count, count(*) filter (s >= 65) as high_risk_sentences, count(*) filter (s > 35 and s < 65) as medium_risk_sentences,
            count(*) filter (s <= 35) as low_risk_sentences, count(*) filter (score is null) as unscored_sentences, round(avg(score), 6) as mean_sentence_risk from b group by 1""",
        "a_fairness_gap": f"with g as ({rates('label = 0', 'ell_status')}) select a.n as n_a, b.n as n_b, a.rate as rate_a, b.rate as rate_b, round(a.rate - b.rate, 6) as rate_difference, a.ci_low <= b.ci_high and b.ci_low <= a.ci_high as intervals_overlap from g a, g b where a.ell_status = 'Yes' and b.ell_status = 'No'",
        "a_folds": f"""with recursive {SCORES}, {ranked_groups('true', 'sc')}, {FOLDS}, x as (select sc.*, fold from sc join folds using (prompt_name)),
            m as (select fold, round(avg(((p >= 0.5) = (label = 1))::int), 6) as accuracy from x group by 1), u as ({AUC.format(by='fold,', part='partition by fold', v='p', src='x', grp='group by fold')})
            select round(avg(accuracy), 5) as mean_accuracy, round(stddev_pop(accuracy), 5) as std_accuracy, round(avg(auc), 5) as mean_auc, round(stddev_pop(auc), 5) as std_auc from m join u using (fold)""",
        "a_length": f"""with {SS}, x as (select row_id, sentence_index, max(score) as score from ss group by 1, 2), r as (select *, row_number() over (partition by row_id order by sentence_index) as r from x),
            t as (select row_id, sentences, count(*) as t, count(score) as n, avg(score) as p, coalesce(stddev_pop(score), 0) as sd from r, (select unnest({list(GRID)}) as sentences) where r <= sentences group by 1, 2 having count(*) = sentences and count(score) > 0),
            l as (select t.*, label, (p >= 0.5)::int as hit, least(1.0, n / 12.0::double) * n / t * (1 - least(1.0, 2 * sd)) as conf from t join train_v2_drcat_02 using (row_id) where label is not null)
            select sentences::int as sentences, count(*) as essays_scored, round(avg(case when label = 1 then hit else 1 - hit end), 6) as accuracy, round(avg(hit) filter (label = 0), 6) as false_positive_rate, round(avg(hit) filter (label = 1), 6) as recall, round(avg(conf), 6) as mean_confidence from l group by 1""",
    }
    names = [f"sentscore_{k}" for k in ("mean", "std", "min", "max", "q10", "q25", "q50", "q75", "q90", "high_risk_fraction", "scorable_count", "range", "top_quartile_mean")]
    zeros = ", ".join(f"coalesce({c}::double, 0) as {c}" for c in names)
    out["j_scored_documents"] = f"""with {SS}, summary as ({out["a_score_summary"].replace(f"with {SS}, ", "with ", 1)}), n as (select row_id, count(*)::double as total_sentence_count from ss group by 1)
        select row_id as essay_id, label, split, {zeros}, total_sentence_count from train_v2_drcat_02 join n using (row_id) left join summary using (row_id)"""
    return out
