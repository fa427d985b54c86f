"""Item selection, reasoning chains, dialogues and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift import fixed_values as fv
from twinsift.functions import text
from twinsift.operators import audit, gates, items, mining, prompts
from twinsift.operators.skew import checked_join, row_number_in_group
from twinsift.plans import evidence as evidence_plans
from twinsift.plans import lenses, pipeline
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.session import materialise

c = F.col


def sql_format(fmt: str, *args: str) -> str:
    """SQL concatenation for a fixed printf format with %s slots."""
    parts = fmt.split("%s")
    out = [s.quoted(parts[0])] if parts[0] else []
    for arg, literal in zip(args, parts[1:]):
        out.append(f"coalesce({arg}, 'null')")
        if literal:
            out.append(s.quoted(literal))
    return "(" + " || ".join(out) + ")"


def _low(x: str) -> str:
    return s.lower_first(s.strip_tail(x))


_TRUE, _OTHER = "true_label", "distractor"
OPENING = sql_format(fv.OPENING_FORMAT, "host", "part", s.lower_first("observation"))
DIAGNOSE = sql_format(fv.DIAGNOSE_FORMAT, _low("sign_true"), _TRUE, _OTHER, _low("sign_other"))
MANAGE = (f"CASE WHEN {s.strip_tail('management')} <> '' THEN {s.upper_first(s.strip_tail('management'))} || '.' "
          f"ELSE {s.quoted(fv.MANAGE_DEFAULT)} END")
REAFFIRM = sql_format(fv.REAFFIRM_FORMAT, _low("sign_true"), _TRUE, _OTHER)
WEATHER = sql_format(fv.WEATHER_FORMAT, _low("sign_true"), _TRUE, _OTHER)
CHAIN = [sql_format(fv.PERCEIVE_FORMAT, "host", "part", s.lower_first("observation")),
         sql_format(fv.READ_SIGN_FORMAT, _low("sign_true")),
         sql_format(fv.RULE_OUT_FORMAT, _OTHER, _low("sign_other")),
         sql_format(fv.CONCLUDE_FORMAT, _TRUE, _OTHER)]


@query("select_items", s.with_lenses("v_sel", """
SELECT pair_id, side, img, crop, disease, split, is_closeup IS NOT NULL AS labelled FROM v_sel"""))
def select_items(t):
    return pipeline.selected(t).select("pair_id", "side", "img", "crop", "disease", "split",
                                       c("is_closeup").isNotNull().alias("labelled"))


@query("reasoning_chain", s.with_lenses("v_ground", f"""
SELECT pair_id, img, side, {" || chr(10) || ".join(f"'{step}|{cites}|' || {line}"
                             for (step, cites), line in zip(fv.CHAIN_STEPS, CHAIN))} AS chain FROM v_ground"""))
def reasoning_chain(t):
    built = items.item_skeleton(pipeline.grounded(t))
    shown = F.array_join(F.transform("cot", lambda x: F.concat_ws("|", x["step"], x["cites"], x["text"])), "\n")
    return built.select("pair_id", "img", "side", shown.alias("chain"))


@query("item_skeleton", s.with_lenses("v_ground", f"""
SELECT 'item-' || img || '-' || pair_id || '-' || side AS item_id, url, cite AS attribution, pair_id, true_label AS true_name,
  distractor, host, part AS anatomical_part, descriptor, state, split, {s.strip_tail('sign_true_full')} AS evidence,
  management FROM v_ground"""))
def item_skeleton(t):
    built = items.item_skeleton(pipeline.grounded(t))
    return built.select(
        "item_id", "image.url", "image.attribution", "lookalike.pair_id", c("lookalike.true").alias("true_name"),
        "lookalike.distractor", "grounding.host", "grounding.anatomical_part", "grounding.descriptor",
        "grounding.state", "split", c("gold.evidence_from_image").alias("evidence"), "gold.management")


@query("expert_turns", s.with_lenses("v_ground", f"""
SELECT pair_id, img, {DIAGNOSE} AS diagnose, {MANAGE} AS manage, {REAFFIRM} AS reaffirm FROM v_ground"""))
def expert_turns(t):
    return pipeline.grounded(t).select(
        "pair_id", "img",
        items.diagnose_line(c("sign_true"), c("true_label"), c("distractor"), c("sign_other")).alias("diagnose"),
        text.management_sentence(c("management")).alias("manage"),
        items.reaffirm_line(c("sign_true"), c("true_label"), c("distractor")).alias("reaffirm"))


_PUSH = "0"
for _w in range(5):
    _PUSH = f"(({_PUSH}) * 4294967296 + CAST('0x' || substr(sha1(img || '|20260613'), {1 + 8 * _w}, 8) AS BIGINT)) % 3"


def _lines(*pairs: tuple[str, str]) -> str:
    return " || chr(10) || ".join(f"'{name}: ' || {line}" for name, line in pairs)


@query("template_dialogue", s.with_lenses("v_ground", f"""
SELECT pair_id, img, {_lines(('F1', OPENING), ('E1', DIAGNOSE), ('F2', s.quoted(fv.SPREAD_QUESTION)), ('E2', MANAGE),
  ('F3', f"[{', '.join(s.quoted(x) for x in fv.PUSHBACK_LINES)}][CAST({_PUSH} AS INT) + 1]"), ('E3', WEATHER))}
  AS dialogue FROM v_ground"""))
def template_dialogue(t):
    g = pipeline.grounded(t)
    return g.select("pair_id", "img", shown_dialogue(items.template_dialogue(g)).alias("dialogue"))


def shown_dialogue(dialogue):
    return F.array_join(F.transform(dialogue, lambda x: F.concat_ws(": ", x["turn"], x["text"])), "\n")


@query("dialogue_plan", """
SELECT conv_id, turn, personality, personality NOT IN ('reticent', 'impatient') AS reaffirms,
  personality IN ('talkative', 'overanxious', 'distrustful') AS closes,
  5 + CAST(personality NOT IN ('reticent', 'impatient') AS INT)
    + CAST(personality IN ('talkative', 'overanxious', 'distrustful') AS INT) AS n_turns
FROM (SELECT *, ['plain','overanxious','distrustful','talkative','reticent','impatient'][(conv_id + turn) % 6 + 1]
  AS personality FROM conversations)""")
def dialogue_plan(t):
    personality = F.get(F.array(*[F.lit(p) for p in fv.PERSONALITIES]),
                        ((c("conv_id") + c("turn")) % 6).cast("int"))
    rows = t.conversations.select("conv_id", "turn", personality.alias("personality"))
    p = c("personality")
    return rows.select("conv_id", "turn", p, items.reaffirms(p).alias("reaffirms"), items.closes(p).alias("closes"),
                       items.planned_turns(p).alias("n_turns"))


_MOD = "0"
for _w in range(5):
    _MOD = (f"(({_MOD}) * 4294967296 + CAST('0x' || substr(sha1('20260613|item-' || img || '-' || pair_id || '-' || side), "
            f"{1 + 8 * _w}, 8) AS BIGINT)) % 37")
_N = "(length(img) + length(pair_id))"


def _said(line: str, fallback: str) -> tuple[str, str]:
    """(text, repaired) of a farmer line in SQL."""
    bare = s.strip_tail(line)
    ended = rf"regexp_matches(regexp_replace({line}, '{s.SPACE}+\z', ''), '[.?!]\z')"
    full = f"(CASE WHEN {line} = '' OR {ended} THEN {bare} ELSE {bare} || '.' END)"
    banned = " OR ".join([f"contains(lower({full}), lower({x}))" for x in (_TRUE, _OTHER)] + [
        f"({x} <> '' AND contains(lower({full}), lower({x})))" for x in ("sign_a", "sign_b")])
    bad = f"({s.strip(full)} = '' OR {banned})"
    return f"CASE WHEN {bad} THEN {fallback} ELSE {full} END", f"CAST({bad} AS INT)"


_OPEN = _said("said_open", OPENING)
_REACT = _said("said_react", s.quoted(fv.FALLBACK_LINES["react"]))
_FOLLOW = _said("said_follow", s.quoted(fv.FALLBACK_LINES["follow"]))
_CLOSE = _said("said_close", s.quoted(fv.FALLBACK_LINES["close"]))
s.add_lens("v_dialogue", f"""v_said AS (
  SELECT g.*, p.personality, observation || ' - can you help?' AS said_open,
    CASE WHEN {_N} % 3 = 0 THEN 'So it is ' || upper(true_label) ELSE 'What now' END AS said_react,
    CASE WHEN {_N} % 4 = 0 THEN '' ELSE 'Are you sure...' END AS said_follow,
    CASE WHEN {_N} % 5 = 0 THEN 'Not ' || distractor || '!' ELSE 'Thanks!' END AS said_close
  FROM v_ground g JOIN personas p ON p.position = {_MOD}),
v_dialogue AS (
  SELECT *, personality NOT IN ('reticent', 'impatient') AS re,
    personality IN ('talkative', 'overanxious', 'distrustful') AS cl,
    {_OPEN[0]} AS f1, {DIAGNOSE} AS e1, {_REACT[0]} AS f2, {MANAGE} AS e2, {_FOLLOW[0]} AS f3, {REAFFIRM} AS e3,
    {_CLOSE[0]} AS f4, {_OPEN[1]} + {_REACT[1]} + {_FOLLOW[1]} + CASE WHEN personality IN
      ('talkative', 'overanxious', 'distrustful') THEN {_CLOSE[1]} ELSE 0 END AS leak_repairs FROM v_said)""",
    ("v_ground", "personas"))


def assembled(t):
    built = pipeline.said_lines(items.item_skeleton(pipeline.grounded(t)))
    return items.assemble_dialogue(items.assign_persona(built, "item_id"))


@query("assemble_dialogue", s.with_lenses("v_dialogue", f"""
SELECT pair_id, img, personality, {_lines(('F1', 'f1'), ('E1', 'e1'), ('F2', 'f2'), ('E2', 'e2'), ('F3', 'f3'))}
  || CASE WHEN re THEN chr(10) || 'E3: ' || e3 ELSE '' END || CASE WHEN cl THEN chr(10) || 'F4: ' || f4 ELSE '' END
  AS dialogue, 5 + CAST(re AS INT) + CAST(cl AS INT) AS n_turns, leak_repairs FROM v_dialogue"""))
def assemble_dialogue(t):
    return assembled(t).select("pair_id", "img", "personality", shown_dialogue("dialogue").alias("dialogue"),
                               "n_turns", "leak_repairs")


@query("dialogue_stats", s.with_lenses("v_dialogue", """
SELECT personality, 5 + CAST(re AS INT) + CAST(cl AS INT) AS n_turns, count(*) AS n_dialogues,
  CAST(sum(leak_repairs) AS BIGINT) AS leak_repairs FROM v_dialogue GROUP BY ALL"""))
def dialogue_stats(t):
    return audit.dialogue_stats(assembled(t))


@query("coverage_summary", s.with_lenses("v_ground", f"""
, f AS (SELECT 1 FROM v_ground WHERE {s.strip("lower(tech_sign)")} <> '' AND contains(lower({OPENING}),
    regexp_replace({s.strip("lower(tech_sign)")}, '\\.+\\z', '')))
SELECT 'pairs' AS section, status AS key, count(*) AS n FROM v_disp GROUP BY ALL
UNION ALL SELECT 'splits', split, count(*) FROM v_ground GROUP BY ALL
UNION ALL SELECT 'failures', 'LEAK: technical decisive sign in farmer turn', count(*) FROM f HAVING count(*) > 0
UNION ALL SELECT 'selfcheck', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM f"""))
def coverage_summary(t):
    gated = pipeline.rows(t)
    disposed = materialise(pipeline.dispositions(t, gated), "dispositions")
    built = items.item_skeleton(pipeline.grounded(t, disposed, gated))
    proof = pipeline.stored_evidence(t).select("pair_id", F.lit(True).alias("has_evidence"),
                                               c("confirmed").alias("web_verified"),
                                               c("source_url").alias("web_source_url"))
    talked = built.withColumn("dialogue", items.template_dialogue(built)).join(proof, "pair_id", "left")
    return audit.coverage_summary(disposed, talked.select("split", gates.item_failures().alias("failures")))


@query("prompt_batch", s.with_lenses("v_gerr v_pairs", f"""
SELECT p.pair_id, 'CROP: ' || p.crop || chr(10) || 'MEMBER_A: ' || p.member_a || ' (class: ' || class_a || '; ' || n_imgs_a
    || ' images)' || chr(10) || 'MEMBER_B: ' || p.member_b || ' (class: ' || class_b || '; ' || n_imgs_b || ' images)' || chr(10)
    || 'shared image descriptors: ' || CASE WHEN len(shared_descriptors) = 0 THEN 'none'
      ELSE array_to_string(shared_descriptors, ', ') END AS context,
  array_to_string(list_transform(range(len(lines)), lambda i: '    - [' || CASE WHEN i = 1 THEN 'decisive'
      WHEN i % 2 = 0 THEN 'supporting' ELSE 'weak' END || '/' ||
      CASE WHEN conv_id % 11 = 0 AND i = 0 THEN 'colour' ELSE {s.AXES}[i % 8 + 1] END || '] ' || lines[i + 1] || ' | A(' || g.member_a
      || '): ' || {s.half('lines[i + 1]', 'a')} || ' | B(' || g.member_b || '): ' || {s.half('lines[i + 1]', 'b')}), chr(10))
    AS exemplar FROM v_pairs p JOIN v_gerr g ON g.pair_id = p.pair_id"""))
def prompt_batch(t):
    exemplars = lenses.graph_store(t).select(
        "pair_id", prompts.fork_lines(c("graph.forks"), c("member_a_label"), c("member_b_label")).alias("exemplar"))
    pairs = lenses.candidate_pairs(t)
    return pairs.join(exemplars, "pair_id").select("pair_id", prompts.pair_context(pairs).alias("context"), "exemplar")


@query("farmer_prompts", s.with_lenses("v_ground personas", f"""
SELECT pair_id, img, id AS persona_id, 'Your crop: ' || host || '. Affected part: ' || part || '.' || chr(10)
  || 'What you can see (in your own words): ' || observation AS prompt
FROM v_ground JOIN personas ON position = {_MOD}"""))
def farmer_prompts(t):
    built = items.assign_persona(items.item_skeleton(pipeline.grounded(t)), "item_id")
    return built.select("pair_id", "img", "persona_id", prompts.farmer_grounding(
        c("host"), c("part"), c("observation")).alias("prompt"))


@query("graph_prompts", s.with_lenses("v_pairs", """
, d AS (SELECT crop, disease, string_agg(descriptor, ', ' ORDER BY n DESC, f) AS top FROM (
    SELECT * FROM (SELECT crop, disease, descriptor, count(*) AS n, min(row_id) AS f FROM v_rows GROUP BY ALL)
    WHERE true QUALIFY row_number() OVER (PARTITION BY crop, disease ORDER BY n DESC, f) <= 4) GROUP BY crop, disease),
nm AS (SELECT crop, disease, sci FROM (SELECT crop, disease, CASE WHEN path_sci <> '' THEN path_sci ELSE path_common END
    AS sci, count(*) AS n, min(row_id) AS f FROM v_rows GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY crop, disease ORDER BY n DESC, f) = 1),
rg AS (SELECT pair_id, string_agg(DISTINCT region, ', ' ORDER BY region) AS regions FROM (
    SELECT pair_id, unnest(shared_states) AS state FROM v_pairs) JOIN us_states u ON u.name = state GROUP BY pair_id)
SELECT p.pair_id, 'CROP: ' || p.crop || chr(10)
  || 'MEMBER_A: ' || member_a || ' (scientific: ' || na.sci || '; class: ' || class_a || '; ' || n_imgs_a
  || ' images; descriptors: ' || da.top || ')' || chr(10)
  || 'MEMBER_B: ' || member_b || ' (scientific: ' || nb.sci || '; class: ' || class_b || '; ' || n_imgs_b
  || ' images; descriptors: ' || db.top || ')' || chr(10) || 'regions of both: ' || coalesce(regions, 'little overlap')
  || chr(10) || 'shared image descriptors: ' || CASE WHEN len(shared_descriptors) = 0 THEN 'none'
    ELSE array_to_string(shared_descriptors, ', ') END AS context
FROM v_pairs p JOIN d da ON da.crop = p.crop AND da.disease = member_a JOIN d db ON db.crop = p.crop AND db.disease = member_b
JOIN nm na ON na.crop = p.crop AND na.disease = member_a JOIN nm nb ON nb.crop = p.crop AND nb.disease = member_b
LEFT JOIN rg ON rg.pair_id = p.pair_id"""))
def graph_prompts(t):
    rows = lenses.image_rows(t)
    nested = mining.nested_pairs(mining.mine_pairs(rows), rows, mining.dominant_name(rows))
    return nested.select("pair_id", prompts.graph_context(nested).alias("context"))


@query("graph_exemplars", s.with_lenses("v_gstore", f"""
SELECT pair_id, 'EXAMPLE (disease): ' || member_a || ' (A) and ' || member_b || ' (B), crop ' || crop || chr(10)
  || 'shared look: ' || v.role || chr(10) || 'forks:' || chr(10)
  || array_to_string(list_transform(range(len(lines)), lambda i: '    - [' || CASE WHEN i = 1 THEN 'decisive'
      WHEN i % 2 = 0 THEN 'supporting' ELSE 'weak' END || '/' ||
      CASE WHEN g.conv_id % 11 = 0 AND i = 0 THEN 'colour' ELSE {s.AXES}[i % 8 + 1] END || '] ' || lines[i + 1] || ' | A(' || member_a
      || '): ' || {s.half('lines[i + 1]', 'a')} || ' | B(' || member_b || '): ' || {s.half('lines[i + 1]', 'b')}), chr(10))
  || chr(10) || 'narrative A: ' || v.text AS exemplar
FROM v_gstore g JOIN conversations v ON v.conv_id = g.conv_id AND v.turn = g.turn"""))
def graph_exemplars(t):
    records = lenses.graph_store(t)
    return records.select("pair_id", prompts.exemplar(records).alias("exemplar"))


@query("photo_prompts", s.with_lenses("v_rows v_store v_gerr", """
, m AS (SELECT crop, disease, arg_max(sign, pair_id) AS sign FROM (
  SELECT e.crop, e.member_a AS disease, g.sign_a AS sign, e.pair_id FROM v_store e JOIN v_gerr g ON g.pair_id = e.pair_id
    WHERE verified AND sign_a IS NOT NULL
  UNION ALL SELECT e.crop, e.member_b, g.sign_b, e.pair_id FROM v_store e JOIN v_gerr g ON g.pair_id = e.pair_id
    WHERE verified AND sign_a IS NOT NULL) GROUP BY ALL)
SELECT img, 'This photo is filed under ' || r.disease || ' on ' || r.crop || '.' || chr(10)
  || 'anatomical_part: the part shown (leaf, stem, root, fruit, flower, pod, seed, whole_plant)' || chr(10)
  || 'is_closeup: whether plant tissue fills the view' || chr(10)
  || 'decisive_sign_visible: whether this can be seen here: ' || sign || chr(10)
  || 'lay_observation: one plain sentence about what looks wrong' AS prompt
FROM v_rows r JOIN m ON m.crop = r.crop AND m.disease = r.disease"""))
def photo_prompts(t):
    rows = lenses.image_rows(t).select("img", "crop", "disease")
    asked = checked_join(rows, evidence_plans.member_signs(t), ["crop", "disease"])
    return asked.select("img", prompts.photo_question(c("crop"), c("disease"), c("sign")).alias("prompt"))


@query("label_prompts", s.with_lenses("v_rows", """
SELECT crop, 'Crop: ' || crop || chr(10) || chr(10) || 'Diseases:' || chr(10)
  || string_agg('- ' || disease, chr(10) ORDER BY disease) AS prompt
FROM (SELECT DISTINCT crop, disease FROM v_rows) GROUP BY crop"""))
def label_prompts(t):
    return prompts.label_question(lenses.image_rows(t))


@query("persona_prompts", s.with_lenses("v_ground personas", f"""
SELECT pair_id, img, 'Your crop: ' || host || '. Affected part: ' || part || '.' || chr(10)
  || 'What you can see (in your own words): ' || observation || chr(10) || 'personality: ' || personality || chr(10)
  || 'language_proficiency: ' || split_part(id, '.', 2) || chr(10) || 'recall: ' || split_part(id, '.', 3) || chr(10)
  || CASE split_part(id, '.', 4) WHEN 'none' THEN 'You follow what you are told.'
    ELSE 'confusion: ' || split_part(id, '.', 4) END AS prompt
FROM v_ground JOIN personas ON position = {_MOD}"""))
def persona_prompts(t):
    built = items.assign_persona(items.item_skeleton(pipeline.grounded(t)), "item_id")
    known = prompts.farmer_grounding(c("host"), c("part"), c("observation"))
    spoken = prompts.persona_behaviour({"confusion": {"none": "You follow what you are told."}})
    return built.select("pair_id", "img", F.concat_ws("\n", known, spoken).alias("prompt"))


@query("ordered_turns", """
SELECT conv_id, turn, speaker, CASE speaker WHEN 'farmer' THEN 'F' ELSE 'E' END || row_number() OVER (
  PARTITION BY conv_id, speaker ORDER BY turn) AS label
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'farmer' ELSE 'expert' END AS speaker FROM conversations)""")
def ordered_turns(t):
    speaker = F.when(c("role") == "user", "farmer").otherwise("expert")
    turns = t.conversations.select("conv_id", "turn", speaker.alias("speaker"))
    numbered = row_number_in_group(turns, ["conv_id", "speaker"], F.floor(c("turn") / 1024), ["turn"], "k")
    label = F.concat(F.when(c("speaker") == "farmer", "F").otherwise("E"), c("k").cast("string"))
    return numbered.select("conv_id", "turn", "speaker", label.alias("label"))


@query("review_sample", s.with_lenses("v_ground", """
, i AS (SELECT *, 'item-' || img || '-' || pair_id || '-' || side AS item_id FROM v_ground),
rep AS (SELECT pair_id, arg_min(img, item_id) AS true_img, arg_min(true_label, item_id) AS true_label,
  arg_min(distractor, item_id) AS distractor FROM i GROUP BY ALL),
own AS (SELECT pair_id, true_label, arg_min(img, item_id) AS img FROM i GROUP BY ALL),
raw AS (SELECT crop, disease, arg_min(img, row_id) AS img FROM v_grows GROUP BY ALL)
SELECT rep.pair_id, p.crop, rep.true_label, true_img, rep.distractor, coalesce(own.img, raw.img) AS distractor_img,
  CASE WHEN own.img IS NOT NULL THEN 'item' ELSE 'raw' END AS distractor_source
FROM rep JOIN v_gpairs p ON p.pair_id = rep.pair_id
LEFT JOIN own ON own.pair_id = rep.pair_id AND own.true_label = rep.distractor
LEFT JOIN raw ON raw.crop = p.crop AND raw.disease = rep.distractor"""))
def review_sample(t):
    rows = pipeline.rows(t)
    built = items.item_skeleton(pipeline.grounded(t, gated=rows)).select(
        "pair_id", "item_id", "img", "true_label", "distractor")
    return audit.review_sample(built, rows, mining.mine_pairs(rows))
