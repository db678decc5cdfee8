"""Simulation settings from an INI file, typed and validated."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    pass


# Sections and keys of the file, with their types. A key with a default may be absent.
REQUIRED = object()
SECTIONS: dict[str, dict[str, tuple[type, object]]] = {
    "Environment": {
        "edgelist": (str, REQUIRED), "nodelist": (str, REQUIRED), "out_degree_bag": (str, REQUIRED), "recency_table": (str, REQUIRED),
        "planted_nodes": (str, REQUIRED), "growth_rate": (float, REQUIRED), "num_cycles": (int, REQUIRED), "recency_bins": (str, REQUIRED),
        "start_from_checkpoint": (bool, REQUIRED), "community_assignment": (str, ""),
    },
    "Agent": {
        "fully_random_citations": (float, REQUIRED), "preferential_weight": (float, REQUIRED), "fitness_weight": (float, REQUIRED),
        "num_authors_weight": (float, REQUIRED), "author_reputation_weight": (float, REQUIRED), "fitness_value_min": (int, REQUIRED),
        "fitness_value_max": (int, REQUIRED), "fitness_lag_duration_min": (int, REQUIRED), "fitness_lag_duration_max": (int, REQUIRED),
        "fitness_peak_duration_min": (int, REQUIRED), "fitness_peak_duration_max": (int, REQUIRED), "same_year_citations": (float, REQUIRED),
        "neighborhood_sample": (int, REQUIRED), "num_authors_bag": (str, REQUIRED), "author_max_lifetime": (int, REQUIRED),
        "cartel_outdegree_proportion": (float, REQUIRED), "null_cartel": (bool, REQUIRED), "clonal_cartel_agent_file": (str, REQUIRED),
        "alpha": (float, REQUIRED), "use_alpha": (bool, REQUIRED), "in_degree_threshold": (int, REQUIRED), "fitness_threshold": (int, REQUIRED),
        "recency_threshold": (int, REQUIRED), "non_random_generator_probability": (float, REQUIRED), "minimum_alpha": (float, 0.0),
        "minimum_preferential_weight": (float, 0.0), "minimum_fitness_weight": (float, 0.0), "theta": (int, -42),
    },
    "General": {"output_file": (str, REQUIRED), "auxiliary_information_file": (str, REQUIRED), "log_file": (str, REQUIRED), "num_processors": (int, REQUIRED), "log_level": (int, REQUIRED), "seed": (int, 0), "keep_fitness": (bool, False)},
}
ALIASES = {"planted_agents": "planted_nodes"}
#: A number that is left empty is absent.
MISSING = -42


@dataclass(frozen=True)
class Config:
    edgelist: str
    nodelist: str
    growth_rate: float
    num_cycles: int
    recency_table: str
    recency_bins: tuple[int, ...]
    out_degree_bag: str
    num_authors_bag: str
    planted_nodes: str
    same_year_citations: float
    start_from_checkpoint: bool
    author_max_lifetime: int
    community_assignment: str
    theta: int
    clonal_cartel_agent_file: str
    preferential_weight: float
    fitness_weight: float
    num_authors_weight: float
    author_reputation_weight: float
    use_alpha: bool
    alpha: float
    minimum_alpha: float
    fully_random_citations: float
    neighborhood_sample: int
    fitness_value_min: int
    fitness_value_max: int
    fitness_lag_duration_min: int
    fitness_lag_duration_max: int
    fitness_peak_duration_min: int
    fitness_peak_duration_max: int
    non_random_generator_probability: float
    in_degree_threshold: int
    fitness_threshold: int
    recency_threshold: int
    cartel_outdegree_proportion: float
    null_cartel: bool
    output_file: str
    auxiliary_information_file: str
    log_file: str
    log_level: int
    num_processors: int
    seed: int
    keep_fitness: bool = False


def parse_bounds(text: str) -> tuple[int, ...]:
    try:
        bounds = tuple(int(x) for x in text.split(","))
    except ValueError as bad:
        raise ConfigError(f"recency_bins: {bad}") from bad
    if not bounds or bounds[0] != 1 or list(bounds) != sorted({*bounds}):
        raise ConfigError("recency_bins must begin at 1 and rise")
    return bounds


def _typed(section: str, key: str, kind: type, text: str) -> object:
    if kind is bool:
        if text not in ("true", "false"):
            raise ConfigError(f"[{section}] {key} must be true or false")
        return text == "true"
    if kind is not str and not text:
        return kind(MISSING)
    try:
        return kind(text)
    except ValueError as bad:
        raise ConfigError(f"[{section}] {key}: {bad}") from bad


def read_config(path: str) -> Config:
    parser = configparser.ConfigParser(inline_comment_prefixes=(";", "#"), interpolation=None)
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    values: dict[str, object] = {}
    for section, keys in SECTIONS.items():
        if not parser.has_section(section):
            raise ConfigError(f"section [{section}] is missing")
        given = {ALIASES.get(k, k): v for k, v in parser.items(section)}
        for key, (kind, default) in keys.items():
            if key in given:
                values[key] = _typed(section, key, kind, given[key])
            elif default is REQUIRED:
                raise ConfigError(f"[{section}] {key} is missing")
            else:
                values[key] = default
    values["recency_bins"] = parse_bounds(str(values["recency_bins"]))
    return validate(Config(**{f.name: values[f.name] for f in fields(Config) if f.name in values}))  # type: ignore[arg-type]


#: Settings that only some runs need.
OPTIONAL = ("alpha", "theta", "minimum_alpha", "minimum_preferential_weight", "minimum_fitness_weight")


def validate(c: Config) -> Config:
    for name in (k for keys in SECTIONS.values() for k, (kind, _) in keys.items() if kind in (int, float) and k not in OPTIONAL):
        if getattr(c, name, 0) == MISSING:
            raise ConfigError(f"{name} has no value")
    for name in ("edgelist", "nodelist", "out_degree_bag", "recency_table", "num_authors_bag", "output_file", "auxiliary_information_file"):
        if not getattr(c, name):
            raise ConfigError(f"{name} has no value")
    if c.use_alpha and c.alpha == MISSING:
        raise ConfigError("alpha is needed with use_alpha")
    if c.community_assignment and c.theta <= 0:
        raise ConfigError("community_assignment needs a theta over 0")
    if not 0 <= c.same_year_citations < 1:
        raise ConfigError("same_year_citations must lie in [0, 1)")
    if c.growth_rate < 0 or c.num_cycles < 0:
        raise ConfigError("growth_rate and num_cycles can't be negative")
    if not 1 <= c.fitness_value_min <= c.fitness_value_max:
        raise ConfigError("fitness values must be 1 <= min <= max")
    for low, high in ((c.fitness_lag_duration_min, c.fitness_lag_duration_max), (c.fitness_peak_duration_min, c.fitness_peak_duration_max)):
        if low > high:
            raise ConfigError("a minimum duration is over its maximum")
    return c
