"""What differs between format versions, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

TEXT, THINK = "text", "thinking"
IMAGES = ("image", "image_url")
AUDIOS = ("input_audio", "audio_url")


@dataclass(frozen=True)
class Version:
    """Rules of one format version. Allowed chunk kinds are by role; a None set of chunk kinds allows all but thinking."""

    number: int
    vocabulary_sizes: dict[str, int]
    chunks: dict[str, tuple[str, ...] | None]
    system_in_place: bool  # own message between markers, else joined to a user message
    system_on: str  # the user message that gets the system prompt otherwise: 'first' or 'last'
    markers: bool  # [INST] as special tokens, else as text
    tools_on: str | None
    content_with_calls: bool
    id_rules: bool  # call and result ids are checked
    id_sets: bool  # results are matched to calls by id, else by count
    reorder_results: bool
    json_results: bool  # text of tool results is re-serialised
    history: bool  # tool messages before the last user message are kept
    truncates: bool
    chunk_joiner: str
    settings: bool
    think: bool
    system_with_audio: bool
    encodes_system_with_audio: bool
    fim: bool
    speech: bool
    roles: tuple[str, ...] = field(default=("system", "user", "assistant", "tool"))


def _chunks(n: int) -> dict[str, tuple[str, ...] | None]:
    user = (TEXT,) if n < 3 else (TEXT, *IMAGES) if n < 7 else (TEXT, *IMAGES, *AUDIOS)
    assistant = (TEXT,) if n < 11 else (TEXT, THINK)
    system = (TEXT,) if n < 7 else (TEXT, "input_audio", THINK) if n < 15 else (TEXT, "input_audio")
    return {"user": user, "assistant": assistant, "system": system, "tool": (TEXT,) if n < 15 else None}


def _version(n: int) -> Version:
    sizes = {1: {"pieces": 32000}, 2: {"pieces": 32768}, 3: {"pieces": 32768, "bytes": 131072}, 7: {"pieces": 32768, "bytes": 131072}}
    return Version(
        number=n, vocabulary_sizes=sizes.get(n, {"bytes": 131072}), chunks=_chunks(n), system_in_place=n >= 7, system_on="first" if n == 1 else "last",
        markers=n > 1, tools_on=None if n == 1 else "last" if n < 13 else "first", content_with_calls=n >= 7, id_rules=n >= 3, id_sets=n >= 11,
        reorder_results=n >= 11, json_results=n < 7, history=n >= 3, truncates=n >= 7, chunk_joiner="" if n >= 15 else "\n\n", settings=n >= 15,
        think=n >= 13, system_with_audio=n >= 11, encodes_system_with_audio=n >= 13, fim=n >= 2, speech=n >= 7,
    )


VERSIONS = {n: _version(n) for n in (1, 2, 3, 7, 11, 13, 15)}
MESSAGE_JOINER = "\n\n"
MODES = ("serving", "finetuning", "test")


def version(name: int | str) -> Version:
    """By number or name, such as 7, 'v7' or 'v7m1' (its multimodal variant)."""
    number = int(str(name).lower().removeprefix("v").split("m")[0])
    if number not in VERSIONS:
        raise ValueError(f"unknown version {name}")
    return VERSIONS[number]
