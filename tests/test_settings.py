from copy import deepcopy

import pytest
import yaml

from sunloom.settings import SettingsError, default_config, load_settings


def changed(path, value):
    config = deepcopy(default_config())
    inner = config
    for p in path[:-1]:
        inner = inner[p]
    inner[path[-1]] = value
    return config


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (("data", "parquet_glob"), " "),
        (("data", "station_id_column"), ""),
        (("data", "station_id_as_feature"), True),
        (("data", "site_metadata", "timezone"), "UTC"),
        (("data", "weather_roles", "ghi"), "nothing"),
        (("features", "prediction_mode"), "other"),
        (("features", "endpoint_horizon_step"), 17),
        (("model", "label_normalization"), "standard"),
        (("model", "label_scale_value"), 2.0),
        (("model", "prediction_clip"), [0.0, 1.0]),
        (("training", "sampling_strategy"), "per_station"),
        (("training", "epochs"), 0),
        (("evaluation", "score_capacity"), 0),
        (("evaluation", "primary_metric"), "rmse"),
        (("evaluation", "early_stopping_prediction"), "clipped"),
        (("split", "train_start"), None),
        (("split", "train_start"), "2025-01-01"),
        (("split", "validation_start"), None),
        (("split", "validation_last_days"), 5),
        (("split", "validation_strategy"), "random"),
        (("split", "validation_strategy"), "monthly_tail"),
        (("split", "confirmation_start"), "2025-01-01"),
        (("split", "train_stations"), []),
        (("split", "train_stations"), ["a", "a"]),
        (("split", "train_stations"), "a"),
        (("split", "test_stations"), [" "]),
    ],
)
def test_rules(path, value):
    with pytest.raises(SettingsError):
        load_settings(changed(path, value))


def test_missing_section():
    config = default_config()
    del config["split"]
    with pytest.raises(SettingsError, match="split"):
        load_settings(config)


def test_roles_and_horizons(tmp_path):
    config = default_config()
    config["features"] |= {"prediction_mode": "curve", "horizons": [4, 1, 4]}
    config["split"] |= {"train_stations": ["a"], "test_stations": ["b"], "confirmation_stations": ["c"]}
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(config))
    s = load_settings(path)
    assert s.horizons == [1, 4]
    assert s.stations("validation") == ["a"]
    assert s.role_union() == ["a", "b", "c"]
    assert load_settings(default_config()).horizons == [16]
    assert load_settings(default_config()).role_union() is None


def test_monthly_tail_validates_on_training_stations():
    config = default_config()
    config["split"] |= {"validation_strategy": "monthly_tail", "validation_last_days": 5, "validation_start": None, "validation_end": None, "train_stations": ["a"]}
    assert load_settings(config).stations("validation") == ["a"]
