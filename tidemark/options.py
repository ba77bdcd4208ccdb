"""Tunables. Defaults are part of behaviour."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20
MAX_SEQ = (1 << 56) - 1
PUT, DELETE = 1, 2


@dataclass(frozen=True)
class Options:
    write_buffer: int = 4 * MIB
    block_size: int = 2 << 10
    table_size: int = 256 * MIB
    compaction_files: int = 25  # inputs of a compaction, in tables' sizes
    l0_slowdown: int = 8
    l0_pause: int = 12
    level_base: int = 10 * MIB
    level_factor: int = 10
    trivial_grandparents: int = 10
    split_grandparents: int = 10  # an output meets so many tables' sizes two levels below, about
    restart_interval: int = 16
    bloom_bits: int = 10
    read_only: bool = False
    keep_hours: float = 24.0  # files younger than that are not removed, whatever names them
    pin_hours: float = 24.0 * 7  # pins and marks of processes older than that are taken for left over

    @property
    def compaction_limit(self) -> int:
        return self.compaction_files * self.table_size

    @property
    def grandparent_limit(self) -> int:
        return self.split_grandparents * self.table_size

    @property
    def l0_trigger(self) -> int:
        return self.l0_pause

    def level_budget(self, level: int) -> int:
        return self.level_base * self.level_factor**level
