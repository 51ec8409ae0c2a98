"""Pages whose text was once lost, and the headers of archives."""

import re

from convolytics.llm import html_text, warc
from convolytics.llm.common import scratch


def test_raw_elements_end_where_they_end_in_the_page():
    page = "<p>" + "İ" * 60 + " one, two.</p><script>x</SCRIPT ><p>Second paragraph kept?</p><style>a</styles></style><p>Third, too.</p>"
    assert html_text.main_text(page).split("\n")[1:] == ["Second paragraph kept?", "Third, too."]


def test_quotes_count_after_an_equals_sign_only():
    page = "<div><p><a href=x title=it's>link</a> first text, that's fine, and more.</p><p class = \"a>b\">It's the second.</p><p id='c>d'>Third.</p></div>"
    assert html_text.main_text(page) == "link first text, that's fine, and more.\nIt's the second.\nThird."
    assert html_text.main_text("<p>Text, before.</p><p class=\"open>Lost in a value that never ends") == "Text, before.\nLost in a value that never ends"


def test_a_page_in_a_form_keeps_its_text_and_loses_controls():
    page = "<body><form id=aspnetForm><input value=x><nav>Menu</nav><div><p>The article, which stands in a form, is long.</p><p>It goes on.</p></div><select><option>a</select><form>Sign up</form></form></body>"
    assert html_text.main_text(page) == "The article, which stands in a form, is long.\nIt goes on."
    assert html_text.main_text("<article><p>The article, beside a form, is long.</p></article><form><p>Sign up now</p></form>") == "The article, beside a form, is long."


def test_record_ids_are_unique_and_revisits_name_their_original(spark):
    rows = [(1, "http://a", "x"), (1, "http://a", "y"), (2, "http://b\n", "x"), (3, None, "y"), (None, "http://n", "x")]
    path = scratch(spark, "archives")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    text = "".join(r[0].decode() for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").collect())
    ids = re.findall("WARC-Record-ID: (.*)\r\n", text)
    assert len(ids) == len(set(ids)) == 5
    assert set(re.findall("WARC-Refers-To: (.*)\r\n", text)) < set(ids)
    assert re.findall("WARC-Refers-To-Target-URI: (.*)\r\n", text) == ["http://a", "http://a"]
    assert not re.search("WARC-Date: 2020-01-01", text) and len(re.findall("WARC-Refers-To-Date: ", text)) == 2
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()) == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1)]
