import pytest

from leafmill.operators import model


class Faulty:
    """Merges paragraphs wherever one of them says so."""

    def __init__(self):
        self.calls = 0

    def complete(self, system, payload):
        self.calls += 1
        blocks = [b.strip() for b in payload.split(model.SEPARATOR)]
        if "poison" in payload and len(blocks) > 1:
            return "merged"
        if system == model.JUDGE_PROMPT:
            return "[]" if "poison" in payload else '[{"faithful":5,"missing":false,"hallucinated":false}]' if len(blocks) == 1 else str([{"faithful": 5}] * len(blocks)).replace("'", '"')
        return f"\n{model.SEPARATOR}\n".join(f"zh:{b}" for b in blocks)


def test_one_result_an_input_under_faults():
    texts = [f"t{i}" for i in range(7)] + ["poison"]
    assert model.translate(texts, "p", Faulty()) == [f"zh:{t}" for t in texts]
    verdicts = model.judge([(t, t) for t in texts], Faulty())
    assert [v["faithful"] for v in verdicts] == [5] * 7 + [0]


def test_other_errors_pass():
    class Down:
        def complete(self, system, payload):
            raise TimeoutError("down")

    with pytest.raises(TimeoutError):
        model.translate(["a"], "p", Down())


def test_units_record_their_errors(spark):
    class Down:
        def complete(self, system, payload):
            if "bad" in payload:
                raise OSError("429 rate limit")
            return payload

    todo = spark.createDataFrame([(1, [("s1", "good")]), (2, [("s2", "bad")])], "unit_id long, texts array<struct<sha:string,en:string>>")
    got = {(r.unit_id, r.zh, r.error) for r in model.translate_units(todo, "p", Down()).collect()}
    assert got == {(1, "good", None), (2, None, "OSError: 429 rate limit")}


def test_replies():
    assert model.object_of('x {"a": 1} y') == {"a": 1}
    for raw in ("[1]", "nothing"):
        with pytest.raises(ValueError):
            model.object_of(raw)
    assert model.text_of('[{"type":"result","result":"t"}]') == "t"
    with pytest.raises(ValueError):
        model.text_of("[]")
