"""Generators that replay recorded text, chosen by a hash of the prompt."""

from __future__ import annotations

import hashlib

from workload.cases import CASES


def _number(prompt: str) -> int:
    return int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)


def load_replay():
    def replay(prompts: list[str]) -> list[str]:
        return [CASES[_number(prompt) % len(CASES)][2] for prompt in prompts]

    return replay


def load_faulty_replay():
    """Fails on about one prompt in seven, and with it the whole batch it is in."""

    def replay(prompts: list[str]) -> list[str]:
        numbers = [_number(prompt) for prompt in prompts]
        if any(number % 7 == 0 for number in numbers):
            raise RuntimeError("device fault")
        return [CASES[number % len(CASES)][2] for number in numbers]

    return replay
