import pytest

from chronofold import ExtractionSettings, extract_features
from chronofold.config import defaults, load
from chronofold.sources.readers import from_rows


def test_empty_file_leaves_the_keys(spark, tmp_path):
    (tmp_path / "c.toml").write_text("")
    df = from_rows(spark, [(k, 1.0) for k in "aabcd"], "id string, val double")
    out = extract_features(df, ExtractionSettings(["id"], ["val"], config_path=str(tmp_path / "c.toml"), order_cols=["ord"]))
    assert out.columns == ["id"] and out.count() == 4


def test_a_file_replaces_the_defaults(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[mean]\n[[quantile.parameters]]\nq = 0.5\n[[autocorrelation.parameters]]\nlag = 2\n")
    assert load(str(path)) == {"mean": [{}], "quantile": [{"q": 0.5}], "autocorrelation": [{"lag": 2}]}
    assert load(str(tmp_path / "none.toml")) == defaults()


@pytest.mark.parametrize("text", ["[mean", "[quantile]", "[[quantile.parameters]]\nx = 1", "[[quantile.parameters]]\nq = 2.0", "[[number_peaks.parameters]]\nn = 0", "[[agg_linear_trend.parameters]]\nchunk_size = 5\naggregator = 'mode'"])
def test_bad_files_raise(tmp_path, text):
    (tmp_path / "c.toml").write_text(text)
    with pytest.raises(ValueError):
        load(str(tmp_path / "c.toml"))
