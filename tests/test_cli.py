"""Settings, and the commands end to end on a small file."""

import json

from pyspark.sql import functions as F

from sievelake import cli, config
from sievelake.operators import facets
from sievelake.sources import jsonl
from sievelake.sources.store import Store


def test_settings():
    assert config.parse_list('["a", " b "]') == config.parse_list("a, b,,") == config.parse_list(["a", "b", ""]) == ["a", "b"]
    assert config.parse_list(None) == []
    s = config.load({"SIEVELAKE_SOURCES": "naukri,linkedin", "SIEVELAKE_MAX_AGE_DAYS": "0", "SIEVELAKE_INCLUDE_INTERNSHIPS": "no", "OTHER": "x"})
    assert s.sources == ("naukri", "linkedin") and s.rules.max_age_days == 0 and not s.rules.include_internships


def test_commands(spark, tmp_path):
    records = [{"title": f"Python Developer {k % 3}", "company": f"C{k}", "location": "Pune", "experience": "0-1 Yrs", "apply_link": "l", "description": "Django and SQL " * 9, "skills": ["SQL"], "scraped_at": "2024-06-20"} for k in range(6)]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records) + "oops\n" + json.dumps({"title": "Sales Executive", "company": "X", "apply_link": "l"}) + "\n")
    store = Store(spark, str(tmp_path / "store"))
    now = F.expr("TIMESTAMP_NTZ '2024-06-30 00:00:00'")
    settings = config.load({})
    done = cli.import_jsonl(spark, store, str(tmp_path / "in.jsonl"), now, settings)
    assert (done["created"], done["updated"], done["malformed"], done["rejections"]) == (6, 0, 1, {"not_tech": 1})
    again = cli.import_jsonl(spark, store, str(tmp_path / "in.jsonl"), now, settings)
    assert (again["created"], again["updated"]) == (0, 6)
    p = cli.current(spark, store)
    assert sorted(r.id for r in p.select("id").collect()) == [1, 2, 3, 4, 5, 6]
    assert cli.reindex(spark, store, now, settings)["retired"] == 0
    assert cli.maintain(spark, store, now, settings) == {"total": 6, "active": 6}
    assert cli.maintain(spark, store, F.expr("TIMESTAMP_NTZ '2024-08-01 00:00:00'"), settings)["active"] == 0
    assert facets.counts(cli.current(spark, store)).first().total == 6
    jsonl.export(p, str(tmp_path / "out"))
