"""Settings of the keyed-table engine. Operators take them as arguments or as a whole; registered queries use the ones of ``plans.registry``."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    wal_size: int = 5
    memtable_size: int = 10
    memtable_threshold: int = 70
    cache_max_size: int = 5
    lsm_max_lvl: int = 3
    lsm_merge_threshold: int = 2
    hll_precision: int = 12
    tokenbucket_size: int = 200
    tokenbucket_interval: int = 60
    cms_epsilon: float = 0.01
    cms_delta: float = 0.01
    bloom_rate: float = 0.01

    @property
    def flush_keys(self) -> int:
        """Distinct keys at which a buffer is flushed."""
        return -(-self.memtable_size * self.memtable_threshold // 100)

    @classmethod
    def from_text(cls, text: str) -> Config:
        """Flat ``key: number`` lines; unknown keys are an error. cms values above 1 are percents."""
        kinds = {f.name: f.type for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition(":"))
            key = {"cmsEpsilon": "cms_epsilon", "cmsDelta": "cms_delta"}.get(key, key)
            if key in ("wal_lwm", "skiplist_max_height"):
                continue  # they steer structures that Spark's storage has no use for
            if key not in kinds:
                raise ValueError(f"unknown setting {key}")
            found[key] = float(value) if kinds[key] == "float" else int(value)
            if key.startswith("cms_") and found[key] >= 1:
                found[key] /= 100
        return cls(**found)
