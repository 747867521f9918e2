"""Special tokens and their ids."""

from __future__ import annotations

from dataclasses import dataclass, field

# Strings and ranks that vocabularies of this format share.
COMMON = [
    "<unk>", "<s>", "</s>", "[INST]", "[/INST]", "[AVAILABLE_TOOLS]", "[/AVAILABLE_TOOLS]", "[TOOL_RESULTS]", "[/TOOL_RESULTS]", "[TOOL_CALLS]",
    "[IMG]", "<pad>", "[IMG_BREAK]", "[IMG_END]", "[PREFIX]", "[MIDDLE]", "[SUFFIX]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "[TOOL_CONTENT]",
]
LATER = {
    "[AUDIO]": 24, "[BEGIN_AUDIO]": 25, "[ARGS]": 32, "[CALL_ID]": 33, "[THINK]": 35, "[/THINK]": 36, "[MODEL_SETTINGS]": 37, "[/MODEL_SETTINGS]": 38,
    "[STREAMING_PAD]": 39, "[STREAMING_WORD]": 40,
}
SPEECH = {"[TRANSCRIBE]": 34, "[NEXT_AUDIO_TEXT]": 35, "[REPEAT_AUDIO_TEXT]": 36}


@dataclass(frozen=True)
class SpecialTokens:
    """Ids 0..size-1 of a vocabulary; places without a name are fillers."""

    size: int = 100
    ranks: dict[str, int] = field(default_factory=lambda: {t: i for i, t in enumerate(COMMON)} | LATER)

    def __post_init__(self) -> None:
        if len(set(self.ranks.values())) != len(self.ranks):
            raise ValueError("two special tokens share a rank")
        if self.ranks and max(self.ranks.values()) >= self.size:
            raise ValueError("a special token's rank exceeds their number")

    def names(self) -> list[str]:
        by_rank = {r: t for t, r in self.ranks.items()}
        return [by_rank.get(i, f"<SPECIAL_{i}>") for i in range(self.size)]

    def id(self, name: str) -> int:
        if name not in self.ranks:
            raise ValueError(f"the vocabulary has no special token {name}")
        return self.ranks[name]


def speech_tokens(size: int = 100) -> SpecialTokens:
    """Of vocabularies for speech, which use the places of the thinking marks."""
    ranks = {t: i for i, t in enumerate(COMMON)} | {t: r for t, r in LATER.items() if r not in SPEECH.values()} | SPEECH
    return SpecialTokens(size, ranks)
