"""Golden lines for quoting, escaping and odd input."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from logloom.functions import columns, convert, patterns
from logloom.operators import extract as x


def blocks(df, job, **kw):
    return [(r["b"], r["error"]) for r in job(df, "raw", "b", **kw).orderBy("i").collect()]


def test_named_groups_become_numbered():
    java, names = patterns.to_java(r"(?P<a>\d+)(?:x|([(]y))(?P<b_c>z)(?P=a)\Z", flags="")
    assert java == r"(\d+)(?:x|([(]y))(z)\1\z" and names == {"a": 1, "b_c": 3}
    assert patterns.group_count(java) == 3


def test_capture_survives_the_separator(texts):
    df = texts("a\x01b c", "plain c").select("i", patterns.capture(F.col("raw"), r"(?s)^(\S+) (.)\z").alias("g"))
    assert [r.g for r in df.orderBy("i").collect()] == [["a\x01b", "c"], ["plain", "c"]]


def test_syslog_forms(texts):
    df = texts('<13>1 2024-01-01T00:00:00Z h a - ID1 [m@1 t="a]b\\"c"][x y="1"] hello', "<14>1 - - - - - - msg", "<165>Oct  5 11:22:33 host app[12]: text\r\n",
               "<1>bare", "no header", "<14>1 2024-01-01T00:00:00Z h a p m [broken text")
    got = blocks(df, x.extract_syslog, reference_year=2024)
    assert got[0][0].sd == '[m@1 t="a]b\\"c"][x y="1"]' and got[0][0].msg == "hello" and got[0][0].severity == "notice"
    assert got[1][0].timestamp is None and got[1][0].hostname == "" and got[1][0].msg == "msg"
    assert (got[2][0].timestamp, got[2][0].app, got[2][0].procid, got[2][0].msg) == ("2024-10-05T11:22:33.000Z", "app", "12", "text")
    assert got[3][0].format == "pri" and got[3][0].severity == "alert"
    assert got[4] == (None, "syslog: no header recognised")
    assert got[5][0].sd == "" and got[5][0].msg == "[broken text"


def test_bsd_header_from_left_to_right(texts):
    """Host, tag, process and content of RFC 3164, its own example first."""
    df = texts("<34>Oct 11 22:14:15 mymachine su: 'su root' failed", "<13>Feb  5 17:32:18 10.0.0.99 app[123]: a\nb", "<13>Feb  5 17:32:18 app[12]: no host", "<13>Feb  5 17:32:18 app: no host",
               "<13>Feb  5 17:32:18 host word rest of it", "<13>2024-01-02T03:04:05.678Z host tag[]: x", "<13>Feb 35 17:32:18 host tag: bad day", "<13>Feb  5 17:32:18 only", "<13>Feb  5 17:32:18 ::1 tag[9 open: x",
               "<13>Feb  5 17:32:18", "<13>Feb  5 17:32:18 h\ttag:\tm", "<13>Feb  5 17:32:18host tag: m")
    got = [(b.format, b.hostname, b.app, b.procid, b.msg) for b, _ in blocks(df, x.extract_syslog, reference_year=2024)]
    assert got == [("rfc3164", "mymachine", "su", "", "'su root' failed"), ("rfc3164", "10.0.0.99", "app", "123", "a\nb"), ("rfc3164", "", "app", "12", "no host"), ("rfc3164", "", "app", "", "no host"),
                   ("rfc3164", "host", "word", "", "rest of it"), ("rfc3164", "host", "tag", "", "x"), ("pri", "", "", "", "Feb 35 17:32:18 host tag: bad day"), ("rfc3164", "", "only", "", ""),
                   ("rfc3164", "::1", "tag", "", "[9 open: x"), ("pri", "", "", "", "Feb  5 17:32:18"), ("rfc3164", "h", "tag", "", "m"), ("pri", "", "", "", "Feb  5 17:32:18host tag: m")]


def test_optional_syslog_keeps_the_line(texts):
    (block, error), = blocks(texts("no header"), x.extract_syslog, optional=True)
    assert block.msg == "no header" and error is None


def test_kv_quotes(texts):
    (m, _), = blocks(texts("a=1 b=\"x \\\" y\" c='q r' d= a=9 e.f=z"), x.extract_kv)
    assert m == {"a": "9", "b": 'x " y', "c": "q r", "d": "", "e.f": "z"}


def test_kv_quoted_inner_quotes(texts):
    (m, _), = blocks(texts('[part@0 key="1" note="say "hi" now" last="z\\]"]'), x.extract_kv_quoted)
    assert m == {"key": "1", "note": 'say "hi" now', "last": "z]"}


def test_cef_escapes_and_labels(texts):
    got = blocks(texts("x CEF:0|A\\|B|P|1|7|n|5|rt=1 cs1Label=kind cs1=v w  msg=a \\= b\\nc", "CEF:0|a", "zz", "CEF:0|a|b|c|d|e|f|"), x.extract_cef)
    assert got[0][0].device_vendor == "A|B" and got[0][0].ext == {"rt": "1", "cs1Label": "kind", "cs1": "v w", "kind": "v w", "msg": "a = b\nc"}
    assert got[1] == (None, "CEF: header incomplete") and got[2] == (None, "CEF: header not found") and got[3][0].ext == {}


def test_leef_delimiters(texts):
    got = blocks(texts("LEEF:1.0|V|P|1|E|a=1\tb=2=3", "LEEF:2.0|V|P|1|E|^|a=1^b=x|y", "LEEF:2.0|V|P|1|E|0x5E|a=1^b=", "LEEF:1|V"), x.extract_leef)
    assert [g[0].ext if g[0] else None for g in got] == [{"a": "1", "b": "2=3"}, {"a": "1", "b": "x|y"}, {"a": "1", "b": ""}, None]
    assert got[3][1] == "LEEF: header incomplete"


def test_winxml(texts):
    got = blocks(texts("<Event xmlns='http://x'><System><Provider Name='P'/><EventID>4624</EventID></System><EventData><Data Name='U'>u &amp; 1</Data><Data>zz</Data></EventData></Event>",
                       "<Event><System/><UserData><L><A>1</A><B x='2'>b&lt;</B></L></UserData></Event>", "<Event><bad"), x.extract_winxml)
    assert got[0][0].System == {"ProviderName": "P", "EventID": "4624"} and got[0][0].EventData == {"U": "u & 1", "Data2": "zz"}
    assert got[1][0].EventData == {"A": "1", "B": "b<"} and got[2] == (None, "winxml: malformed XML")


def test_split_errors_and_surplus(texts):
    got = blocks(texts('a | "b" | c | d', "a"), x.extract_split, sep="|", names=["x", "y", "z"], min_fields=3)
    assert (got[0][0].x, got[0][0].y, got[0][0]._extra) == ("a", "b", ["d"]) and got[1] == (None, "split: 1 fields, at least 3 expected")


def test_first_failure_names_the_error(texts):
    df = x.extract_json(texts("plain"), "raw", "j")
    df = x.extract_cef(df, "raw", "c")
    df = x.extract_regex(df, "raw", "r", r"(?P<a>\d)", when=F.lit(False))
    assert df.first()["error"] == "json: not valid JSON"


def test_long_lines_do_not_overflow(texts):
    long = texts("x=" * 100_000 + '"', 'a="' + '\\"' * 100_000, " " * 200_000 + "k=v")
    sizes = long.select("i", F.size(x.kv_map(F.col("raw"))).alias("a"), F.size(x.kv_quoted_map(F.col("raw"))).alias("b"), F.size(x.cef_extension(F.col("raw"))).alias("c"))
    assert len(sizes.collect()) == 3


@pytest.mark.parametrize("text", ["1.2.3.4", "1.2.3.4:80", " [2001:DB8::1] ", "10.0.0.0/8", "::", "::1", "1::", "fe80:0:0:1::", "2001:db8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8",
                                  "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1.2.3", "256.1.1.1", "01.2.3.4", "2026:01:00:37", "1::2::3", ":::", "12345::", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:0:3",
                                  "abc", "1:2:3:4:5:6:7", "1:", ":1:2:3:4:5:6:7:8", "2001:0db8:0000:0000:0000:ff00:0042:8329"])
def test_ip(spark, texts, text):
    s = text.strip().strip("[]").split("/")[0]
    s = s.split(":")[0] if s.count(":") == 1 and "." in s else s
    try:
        want = str(ipaddress.ip_address(s))
    except ValueError:
        want = None
    assert texts(text).select(convert.to_ip(F.col("raw")).alias("o")).first().o == want


def test_times(texts):
    shown = lambda *t: [r.o for r in texts(*t).select("i", convert.iso_ms(convert.to_time(F.col("raw"))).alias("o")).orderBy("i").collect()]
    assert shown("2026-10-05T11:38:35.123456789-03:00", "1700000000.5", "20261005", "2026", "2026-13-05") == [
        "2026-10-05T14:38:35.123Z", "2023-11-14T22:13:20.500Z", "2026-10-05T00:00:00.000Z", None, None]


def test_urls(texts):
    df = texts("https://User:pw@Ex.COM:8443/a/b?c=d#f", "example.org/x", "/only/path?q=1", "a.b:99999/x", "http://[::1]:80/").select("i", convert.url_parts(F.col("raw")).alias("u"))
    assert [tuple(r.u)[1:] for r in df.orderBy("i").collect()] == [("https", "ex.com", 8443, "/a/b", "c=d"), (None, "example.org", None, "/x", None), (None, None, None, "/only/path", "q=1"),
                                                                   (None, "a.b", None, "/x", None), ("http", "::1", 80, "/", None)]


def test_mojibake_cp1252(texts):
    df = x.fix_mojibake(texts("InformaÃ§Ãµes", "Informações", "â€œÃ¡", "€ Ã¡"), "raw")
    assert [r.raw for r in df.orderBy("i").collect()] == ["Informações", "Informações", "“á", "€ Ã¡"]


def test_lookup_is_bounded():
    with pytest.raises(ValueError):
        columns.lookup(None, {str(i): i for i in range(columns.MAX_LITERAL_TABLE + 1)})
