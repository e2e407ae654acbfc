"""The url models read whole urls."""

from brisa.llm.urlmodel import judge_urls


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in judge_urls(df).collect()}


def test_scheme_less_query_and_case(spark):
    train = [f"http://a{i}.org/{i}?page={i}" for i in range(30)] + [f"http://b{i}.com/de/{i}?spam={i}" for i in range(30)]
    urls = [*train, "example.net/x?page=1", "example.net/x?spam=1", "http://c.net/x?page=7", "http://c.net/x?spam=7",
            "http://c.net/x#spam=7", "http://c.net/spam", "http://c.net/SPAM", None, ""]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    page, spam, page2, spam2, mark, low, up, null, empty = (got[k] for k in range(60, 69))
    assert page.host == spam.host == page.path == "" and page.score > spam.score and page2.score > spam2.score
    assert len({page2.score, spam2.score, mark.score}) == 3 and low.score != up.score
    assert null.score == empty.score and (null.host, null.path, null.rule) == ("", "", None)
