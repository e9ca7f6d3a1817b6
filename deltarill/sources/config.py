"""Run configuration: ``KEY=value`` lines, ``#`` and ``%`` comments, blanks around both sides ignored."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: fixed values: the keys and what they set
KEYS = {
    "ALGORITHM": "algorithm", "EXE_THREADS": "compute_partitions", "IO_THREADS": "scan_partitions", "NSHARDS": "num_shards", "INPUT": "input",
    "RESULT": "result", "NODES": "nodes", "TERMTHRESH": "tolerance", "PORTION": "portion", "MENBUDGET_MB": "budget_mb",
    "DISABLE-MODTIME-CHECK": "reuse_prepared", "TERMCHECKINTERVAL": "check_every",
}


@dataclass
class Config:
    algorithm: str = "pagerank"
    compute_partitions: int = 0
    scan_partitions: int = 1
    num_shards: str = "auto"
    input: str = "input/pagerank"
    result: str = "input/pagerank"
    nodes: int = 0
    tolerance: float = 0.0
    portion: float = 1.0
    budget_mb: int = 1024
    reuse_prepared: bool = False
    check_every: int = 1

    def __post_init__(self):
        if not 0 < self.portion <= 1:
            raise ValueError("PORTION must be in (0, 1]")

    def set(self, key: str, value: str) -> Config:
        return parse(f"{key}={value}", self)


def parse(text: str, base: Config | None = None) -> Config:
    """Unknown keys are ignored, as is a line without ``=``; of repeated keys the last counts."""
    kinds = {f.name: type(f.default) for f in fields(Config)}
    got = dict(vars(base)) if base else {}
    for line in text.splitlines():
        s = line.strip(" \f\n\r\t\v")
        if not s or s[0] in "#%" or "=" not in s:
            continue
        key, _, value = s.partition("=")
        name = KEYS.get(key.strip(" \f\n\r\t\v"))
        value = value.strip(" \f\n\r\t\v")
        if name:
            kind = kinds[name]
            got[name] = value not in ("0", "", "false") if kind is bool else int(float(value)) if kind is int else kind(value)
    return Config(**got)


def load(path: str) -> Config:
    with open(path) as f:
        return parse(f.read())
