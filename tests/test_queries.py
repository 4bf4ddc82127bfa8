from __future__ import annotations

from corpuskit.operators.queries import DAY, understand_queries

NOW = 1_706_745_600


def test_understanding(spark):
    raw = {
        1: 'that "attention is all" pdf about transformers',
        2: "mac app for window tiling",
        3: "tools saved a few weeks ago",
        4: "type:pdf kind:paper since:7d domain:www.arxiv.org scaling laws",
        5: "notes from 3 days ago",
        6: "rust rust serialization",
        7: "",
        8: None,
        9: "the github repo since:2024-01-01 until:2024-01-15",
    }
    got = {r.query_id: r for r in understand_queries(spark.createDataFrame(list(raw.items()), "query_id long, raw string"), NOW).collect()}
    assert got[1].tokens == ["transformers"] and got[1].phrases == [["attention", "is", "all"]] and got[1].types == ["pdf"] and got[1].cue_tokens == ["pdf"]
    assert got[2].kinds == ["macos_app"] and got[2].cue_tokens == ["mac", "app"] and got[2].tokens == ["window", "tiling"]
    assert got[3].kinds == ["macos_app", "cli_tool", "saas_product"] and got[3].tokens == []
    assert (got[3].since, got[3].until) == (NOW - 35 * DAY, NOW - 10 * DAY)
    assert (got[4].types, got[4].kinds, got[4].domains, got[4].strict) == (["pdf"], ["paper"], ["arxiv.org"], True)
    assert got[4].since == NOW - 7 * DAY and got[4].until is None and got[4].tokens == ["scaling", "laws"]
    assert got[5].note_cue and (got[5].since, got[5].until) == (NOW - 5 * DAY, NOW - 1 * DAY) and got[5].tokens == []
    assert got[6].tokens == ["rust", "serialization"] and not got[6].strict and got[6].since is None
    assert got[7].tokens == [] and got[8].tokens == [] and got[8].embed_text == ""
    assert got[9].subtypes == ["github_repo"] and got[9].since == 1_704_067_200 and got[9].until == 1_705_276_800
