import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limpid.functions import urls


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("u"))).collect()]


VECTORS = [
    ("HTTP://Ex.COM:80/A?b=1", "http://ex.com/A?b=1", "HTTP://Ex.COM:80"),
    ("https://Ex.com:443", "https://ex.com", "https://Ex.com:443"),
    ("https://ex.com:8443/P", "https://ex.com:8443/P", "https://ex.com:8443"),
    ("ftp://ex.com:21/x", "ftp://ex.com:21/x", "ftp://ex.com:21"),
    ("noscheme", "noscheme", "noscheme"),
    ("", "", ""),
    (None, None, None),
    ("http://ex.com:8080/", "http://ex.com:8080/", "http://ex.com:8080"),
    ("GOPHER://Ex.com/a", "GOPHER://ex.com/a", "GOPHER://Ex.com"),
]


def test_vectors(spark):
    given_ = [v[0] for v in VECTORS]
    nested = apply(spark, lambda c: urls.lower_host(urls.strip_default_port(urls.lower_scheme(c))), given_)
    assert nested == [v[1] for v in VECTORS]
    assert apply(spark, urls.clean, given_) == nested
    assert apply(spark, urls.strip_path, given_) == [v[2] for v in VECTORS]


def test_host_drops_login_and_port(spark):
    values = ["https://u:p@Ex.com:81/a@b", "https://ex.com?x=/y", "Plain.Text", "http://[::1]:80/x", "http:///x", None]
    assert apply(spark, urls.host, values) == ["ex.com", "ex.com?x=", "plain.text", "[::1]", "", None]
    assert apply(spark, urls.authority_host, values) == ["ex.com", "ex.com", None, "[::1]", None, None]


def test_scheme_and_known(spark):
    values = ["HTTPS://a", "gopher://a", "://a", "a", None]
    assert apply(spark, urls.scheme, values) == ["https", "gopher", None, None, None]
    assert apply(spark, urls.known_scheme, values) == [True, False, False, False, False]


def test_email(spark):
    values = [" Ann.B @ Mail . Ex . COM ", "x@y@Z.c", "NoAt", None]
    assert apply(spark, urls.clean_email, values) == ["Ann.B@mail.ex.com", "x@y@z.c", "noat", None]
    assert apply(spark, urls.email_domain, values) == ["mail.ex.com", "y@z.c", None, None]


def test_present(spark):
    assert apply(spark, urls.present, ["a", "", " \t", " 　", None]) == [True, False, False, False, False]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("htps:/ABc.8043@?é"), max_size=24), min_size=1, max_size=30))
def test_idempotent(spark, values):
    # one port is taken off per pass, so only URLs with ports one behind the other may change again
    values = [v for v in values if v.count(":80") + v.count(":443") < 2]
    once = apply(spark, urls.clean, values) if values else []
    assert (apply(spark, urls.clean, once) if once else []) == once


@pytest.mark.parametrize("n", [0, 1, 128, 129])
def test_length(spark, n):
    assert apply(spark, lambda c: urls.fits(c, 1, 128), ["a" * n]) == [1 <= n <= 128]
