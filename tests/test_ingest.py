import pytest

from rankboard.operators import roster as R
from rankboard.sources import directory as D

GOOD = '{"Resources":[{"id":"1","userName":"a","displayName":"A","active":true,"emails":[{"value":"a@x"}]}]}'
CUT = '{"Resources":[{"id":"2","userName":"b"'
TYPED = '{"Resources":[{"id":"3","userName":"c","displayName":"C","active":"true","emails":[]}]}'
SPREAD = '{\n "Resources": [\n  {"id": "4", "userName": "d", "displayName": "D",\n   "active": true, "emails": []}\n ]\n}'


def _write(scratch, name, text):
    with open(f"{scratch}/{name}.json", "w") as f:
        f.write(text + "\n")
    return scratch


@pytest.mark.parametrize("bad", [CUT, TYPED, SPREAD])
def test_malformed_page_raises(spark, scratch, bad):
    _write(scratch, "good", GOOD)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        R.ingest_directory(D.read_directory_pages(spark, _write(scratch, "bad", bad))).collect()


def test_page_over_several_lines(spark, scratch):
    _write(scratch, "good", GOOD)
    got = R.ingest_directory(D.read_directory_pages(spark, _write(scratch, "spread", SPREAD), whole_documents=True))
    assert sorted(r["user_id"] for r in got.collect()) == ["1", "4"]


def test_malformed_text_in_a_column_raises(spark):
    text = spark.createDataFrame([(GOOD,), (CUT,)], "value string")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        D.parse_directory_pages(text).collect()
