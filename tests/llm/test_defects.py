import json

import pytest

from folioflow.llm.defects import DEFECTS, FUNCTIONS, REFUSALS, _model, choose_cutoffs, defects, plant, planted, posteriors, take_apart, votes

EN = ["The paper is clearly written and the decoder is a sensible choice for this task.", "My main concern is that the corpus has only 118 items, so a gain of 3 percent may be noise.", "The claim that the model halves the error is not supported by Table 5 of the paper."]
ZH = ["论文写作清晰，采用混合聚合模块处理天文中的信息抽取是合理的选择，附录中的案例也有帮助。", "我的主要疑虑在于数据集仅有七十条样本，覆盖率提升八个百分点可能只是噪声。", "我无法核实作者的这一结论，建议补充重复实验。"]
FR = ["Nous étudions la sélection de manuscrits et présentons une méthode légère entraînée sur des exemples annotés.", "Le rapporteur s'étonne que la méthode n'ait pas été comparée à une référence adaptée.", "Les résultats montrent que l'erreur moyenne diminue même lorsque les données sont bruitées."]
PROMPT = "Review this.\n[abstract-p01] Existing approaches rely on a retrieval-backed transformer, which is known to fail across all random seeds. We study navigation in astronomy and propose a spectral denoiser that needs few annotated examples. Our experiments use a treebank with 242 records, split by site rather than by record."


def review(parts, **more):
    return json.dumps({"summary": parts[0], "strengths": [parts[2]], "major_concerns": [{"id": "M1", "problem": parts[1], "evidence": [{"paragraph_id": "abstract-p01", "excerpt": PROMPT[14:120]}]}], "questions": [], "limitations": [parts[0]], **more}, ensure_ascii=False)


ANSWERS = {
    1: ("en", review(EN), None),
    2: ("zh-CN", review(ZH), None),
    3: ("en", "```json\n" + review(EN)[:-1] + ",}\n```", None),
    4: ("en", "Summary: " + EN[0] + "\n\nConcerns: " + EN[1] + "\n\nVerdict: " + EN[2], None),
    10: ("en", "", "empty"),
    11: ("en", None, "empty"),
    12: ("en", '```json\n{"summary": null}\n```', "empty"),
    13: ("zh-CN", "​", "empty"),
    14: ("en", "N/A", "empty"),
    20: ("en", "I'm sorry, but I cannot assist with reviewing this manuscript.", "refusal"),
    21: ("zh-CN", '{"summary": "很抱歉，此内容超出了我可以处理的范围，恕不能评价。"}', "refusal"),
    22: ("zh-CN", "对不起，我没有权限评审未发表的论文，请联系专业审稿人。", "refusal"),
    30: ("en", PROMPT[13:], "copied"),
    31: ("zh-CN", json.dumps({"summary": PROMPT[29:], "strengths": [], "limitations": []}), "copied"),
    40: ("en", review(EN)[:300], "truncated"),
    41: ("en", json.dumps({"summary": EN[0], "strengths": [EN[1][:40]]}), "truncated"),
    42: ("en", "Summary: " + EN[0] + "\n\nConcerns: " + EN[1][:50], "truncated"),
    50: ("en", review(ZH), "other_language"),
    51: ("en", review(FR), "other_language"),
    52: ("zh-CN", review(EN), "other_language"),
}


def row(i, language, raw, status="ok"):
    return (i, language, PROMPT, status, raw, None, "stop", (None,))


SCHEMA = "run_id bigint, review_language string, prompt string, status string, raw_output string, parse_error string, finish_reason string, usage struct<output_tokens int>"


def test_every_defect_and_no_other(spark):
    rows = [row(i, a, b) for i, (a, b, _) in ANSWERS.items()] + [row(1000 + i, "en", review(EN)) for i in range(60)]
    rows += [rows[0], row(900, "en", None, "error"), (None, "en", PROMPT, "ok", "x", None, None, None)]
    got = {x.run_id: x.defects[0] for x in defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: d for i, (_, _, d) in ANSWERS.items() if d}


def test_nulls_everywhere():
    v = votes(dict.fromkeys(("raw_output", "prompt", "parse_error", "finish_reason", "review_language", "output_tokens")))
    assert {d: len(x) for d, x in v.items()} == {d: FUNCTIONS[d] for d in DEFECTS} and v["empty"][0] == 1


def test_label_model_weighs_a_noisy_function_less():
    p = posteriors({"111": 40, "110": 40, "000": 700, "001": 220})
    assert p["110"] > 0.9 and p["001"] < 0.1 and p["000"] < 0.01
    assert posteriors({}) == {} and posteriors({"___": 9})["___"] < 0.1


def test_no_runs(spark):
    assert defects(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["x" * 200_000, '{"summary": "' + "a b " * 50_000, "{" * 5000])
def test_long_and_odd_texts(text):
    votes({"raw_output": text, "prompt": text, "parse_error": None, "finish_reason": None, "review_language": "en", "output_tokens": None})


def test_a_long_refusal_is_one():
    long = REFUSALS["en"][0] + " The request asks for a judgement that is not mine to give. " * 30
    run = {"raw_output": long, "prompt": PROMPT, "parse_error": None, "finish_reason": None, "review_language": "en", "output_tokens": None}
    assert votes(run)["refusal"][0] == 1


def test_json_behind_a_long_preface():
    assert take_apart("Here is my review, as asked for. " * 20 + review(EN)).json


def test_cutoffs_are_chosen_on_planted_defects(spark):
    rows = [row(i, "zh-CN" if i % 2 else "en", review(ZH if i % 2 else EN)) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.asDict() for r in planted(df, 40).collect()]
    assert len({r["k"] for r in got}) == 40 and {r["planted"] for r in got} == {"", *DEFECTS}
    chances = {d: posteriors({r[d]: 5 for r in got}) for d in DEFECTS}
    cutoffs, measured = choose_cutoffs(got, chances)
    assert set(cutoffs) == set(DEFECTS) and all(0 < x < 1 for x in cutoffs.values())
    assert all(right > 0 and wrong == 0 for _, right, wrong, _ in measured)
    assert choose_cutoffs([], chances)[0] == dict.fromkeys(DEFECTS, 0.5)
    assert plant({"raw_output": None, "prompt": None, "review_language": None}, "", 0)["truncated"]["raw_output"] == ""


def test_every_answer_chooses_or_validates(spark):
    """All 700 answers have a say, and the counts give what the answers one by one give."""
    rows = [row(i, "zh-CN" if i % 2 else "en", review(ZH if i % 2 else EN)) for i in range(700)]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    _, chances, cutoffs, measured = _model(df)
    one_by_one = [r.asDict() for r in planted(df).collect()]
    assert (cutoffs, measured) == choose_cutoffs(one_by_one, chances)
    other = choose_cutoffs(one_by_one, chances, 1)[1]
    assert all(a[1] + a[3] + b[1] + b[3] == 700 and not a[2] and not b[2] for a, b in zip(measured, other, strict=True))
