"""Reading and writing logs, lists, cases and memories."""

import json

from termloom.operators import memory, resolve
from termloom.sources import tables


def test_word_list(spark, tmp_path):
    (tmp_path / "words").write_text("# list\nThe\n  page \n\nthe\n")
    assert {r.word for r in tables.common_words(spark, str(tmp_path / "words")).collect()} == {"the", "page"}


def test_cases_have_their_own_histories(spark, tmp_path):
    seed = [{"kind": "dictionary_add", "canonical": "Zoho"}]
    (tmp_path / "seed.json").write_text(json.dumps({"observations": seed}, indent=1))
    cases = [
        {"id": "with", "asr": "zoho mira", "formatted": "", "expected": "Zoho Mira", "expect_intervention": True, "observations": [{"kind": "dictionary_add", "canonical": "Mira"}]},
        {"id": "without", "asr": "zoho", "expected": "zoho", "skip_seed": True},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=1))
    read = tables.cases(spark, str(tmp_path / "cases.json"))
    log = tables.case_log(read, tables.observations(spark, str(tmp_path / "seed.json")))
    m = memory.fold(log)
    said = read.selectExpr("id as scope", "1L as utt_id", "asr", "formatted")
    assert {r.scope: r.memory_aware for r in resolve.resolve(said, m).collect()} == {"with": "Zoho Mira", "without": "zoho"}
    tables.write_memory(m, str(tmp_path / "memory"))
    assert tables.read_memory(spark, str(tmp_path / "memory")).entries.count() == 2
    tables.append_observations(log, str(tmp_path / "log"))
    tables.append_observations(log, str(tmp_path / "log"))
    assert tables.observation_lines(spark, str(tmp_path / "log")).count() == 2 * log.count()
