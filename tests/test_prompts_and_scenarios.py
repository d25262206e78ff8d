import json

import pytest
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import templates
from talkgauge.sources import scenarios


def rendered(spark, template, variables, session="s1"):
    df = spark.createDataFrame(
        [(template, variables, session)], "t string, v map<string,string>, s string"
    )
    text, status = templates.render(F.col("t"), F.col("v"), F.col("s"))
    return tuple(df.select(text, status).first())


T = "S {session_id} {{x}} G {ORDER_GOAL} D {CURRENT_DATE}"


@pytest.mark.parametrize(
    "template, variables, text, status",
    [
        (
            T,
            {"ORDER_GOAL": '[{"n":"{session_id}"}]', "CURRENT_DATE": "d"},
            'S s1 {x} G [{"n":"{session_id}"}] D d',
            "rendered",
        ),
        (T, {}, T, "missing_variable"),
        (T, None, T, "missing_variable"),
        ("{session_id}", {"session_id": "other"}, "s1", "rendered"),
        ("plain", {"unused": "x"}, "plain", "rendered"),
        ("", {}, "", "rendered"),
        ("{a}", {"a": None}, "None", "rendered"),
        ("{{{a}}}", {"a": "v"}, "{v}", "rendered"),
        ("{", {}, None, "bad_template"),
        ("a } b", {}, None, "bad_template"),
        ("{}", {}, None, "bad_template"),
        ("{0}", {"0": "v"}, None, "bad_template"),
        ("{a} {", {}, "{a} {", "missing_variable"),
        ("{ {a}", {}, None, "bad_template"),
        ("{a:>5}", {"a": "v"}, None, "bad_template"),
        ("цена {ЦЕНА}", {"ЦЕНА": "$1\\2"}, "цена $1\\2", "rendered"),
    ],
)
def test_render(spark, template, variables, text, status):
    assert rendered(spark, template, variables) == (text, status)


@pytest.mark.parametrize(
    "raw, error",
    [
        ("[]", "No scenarios provided"),
        ("{}", "No scenarios provided"),
        ("null", "No scenarios provided"),
        ("0", "No scenarios provided"),
        ('""', "No scenarios provided"),
        ("not json", "No scenarios provided"),
        (None, "No scenarios provided"),
        ('{"a":1}', "Scenarios must be a list"),
        ("7", "Scenarios must be a list"),
        ("[7]", "Scenario 0 must be an object"),
        ("[null]", "Scenario 0 must be an object"),
        ('[{"name":"a","variables":{}},{"name":"b"}]', "Scenario 1 missing 'variables' field"),
        ('[{"variables":{}}]', "Scenario 0 missing 'name' field"),
        ('[{"name":null,"variables":null}]', None),
        ('[{"name":"a","variables":5}]', None),
        ('[{"name":"a","variables":{}},[],{}]', "Scenario 1 must be an object"),
    ],
)
def test_validation_messages(spark, raw, error):
    df = spark.createDataFrame([(raw,)], "scenarios string")
    assert scenarios.validate_scenarios(df).first().error == error


SAMPLE = [
    {"name": "a", "variables": {"PATIENCE": 2, "GOAL": '[{"q":1}]', "LOCATIONS": "Москва"}},
    {"name": "b", "variables": {"SEED": 7}},
    {"variables": {}},
]


def test_read_scenarios_keeps_order_and_values(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SAMPLE, ensure_ascii=False, indent=1), "utf-8")
    rows = sorted(scenarios.read_scenarios(spark, str(tmp_path / "s.json")).collect(), key=lambda r: r.scenario_index)
    assert [r.name for r in rows] == ["a", "b", None]
    assert rows[0].variables == {"PATIENCE": "2", "GOAL": '[{"q":1}]', "LOCATIONS": "Москва"}
    assert rows[1].variables == {"SEED": "7"}


@pytest.mark.parametrize("text", ['{"name":"a"}', "7", "oops"])
def test_scenario_file_must_hold_an_array(spark, tmp_path, text):
    (tmp_path / "s.json").write_text(text, "utf-8")
    with pytest.raises(Exception, match=c.MESSAGE_FILE_NOT_AN_ARRAY):
        scenarios.read_scenarios(spark, str(tmp_path / "s.json")).collect()


def test_prompt_templates_with_fallbacks(spark, tmp_path):
    (tmp_path / "agent_system.txt").write_text("Line 1\nСтрока {x}\n", "utf-8")
    (tmp_path / "other.md").write_text("ignored", "utf-8")
    names = ["agent_system", "client_system", "evaluator_system"]
    out = dict(scenarios.read_prompt_templates(spark, str(tmp_path), names).collect())
    assert out == {
        "agent_system": "Line 1\nСтрока {x}\n",
        "client_system": "You are a client system.",
        "evaluator_system": c.EVALUATOR_FALLBACK_TEMPLATE,
    }
