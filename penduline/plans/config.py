"""Settings of tasks, protocols, prompt profiles and media, checked on the driver: each is one small document."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from penduline.operators.lineage import digest

# Task families with the view each reads, and conditionings.
FAMILIES = {"finetune_eval": "view_a", "direct_eval": "view_b"}
CONDITIONINGS = ("generic", "physics")


@dataclass(frozen=True)
class Task:
    task_id: str
    family: str
    conditioning: str
    inference_seeds: tuple[int, ...]
    training_seeds: tuple[int, ...] = ()
    scenes: tuple[str, ...] | None = None
    partitions: tuple[str, ...] | None = None
    case_ids: tuple[str, ...] = ()
    held_out_scenes: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        faults = []
        if self.family not in FAMILIES:
            faults.append(f"unknown family {self.family}")
        if self.conditioning not in CONDITIONINGS:
            faults.append(f"unknown conditioning {self.conditioning}")
        if not self.inference_seeds:
            faults.append("at least one inference seed is needed")
        if self.family == "finetune_eval" and len(self.training_seeds) != 1:
            faults.append("exactly one training seed is needed")
        if self.family == "finetune_eval" and self.case_ids:
            faults.append("single cases can be chosen for direct evaluation only")
        if set(self.held_out_scenes) & set(self.scenes or ()):
            faults.append("held-out scenes are among the scenes trained on")
        if faults:
            raise ValueError("; ".join(faults))

    def narrowed(self, scenes: tuple[str, ...] = (), partitions: tuple[str, ...] = (), case_ids: tuple[str, ...] = ()) -> Task:
        """The task on fewer scenes, partitions or cases; order is kept, repeats are dropped."""
        if self.family != "direct_eval" and (partitions or case_ids):
            raise ValueError("partitions and cases can be narrowed for direct evaluation only")
        one = lambda new, old: tuple(dict.fromkeys(new)) or old
        return Task(self.task_id, self.family, self.conditioning, self.inference_seeds, self.training_seeds, one(scenes, self.scenes), one(partitions, self.partitions), one(case_ids, self.case_ids), self.held_out_scenes, self.settings)

    def fingerprint(self) -> str:
        return digest({k: list(v) if isinstance(v, tuple) else v for k, v in self.__dict__.items() if k != "settings"})


def load_protocol(path: str | Path) -> dict:
    """A protocol with its path and fingerprint. Its id must be the name of its file."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if value.get("protocol_id") != Path(path).stem or not isinstance(value.get("scenes"), dict):
        raise ValueError("a protocol needs scenes, and the name of its file as its id")
    return {**value, "path": str(path), "fingerprint": digest(value)}


def media_faults(buckets: dict[str, tuple[int, int]], least_frames: int, most_frames: int) -> list[str]:
    """Faults of the sizes of scenes and of frame limits."""
    out = [f"{scene}: {w}x{h} is no multiple of 16" for scene, (w, h) in sorted(buckets.items()) if w % 16 or h % 16]
    out += [f"{n} frames are not 4n + 1" for n in (least_frames, most_frames) if n % 4 != 1]
    return out + (["least above most frames"] if least_frames > most_frames else [])


def load_bundle(path: str | Path) -> dict:
    """The document of a baseline, with its folder and fingerprint. Adapters belong into its task builder."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    # What a bundle must hold, and what it must not.
    faults = [f"no {k}" for k in ("baseline_id", "plugin", "capabilities", "components") if k not in value]
    parts = value.get("components", {})
    faults += [f"no component {k}" for k in ("task_builder", "trainer", "predictor") if k not in parts]
    faults += [f"{k} is no component of its own" for k in ("condition_adapter", "data_adapter") if k in parts]
    if value.get("schema_version") != "2.0":
        faults.append("schema_version is not 2.0")
    if faults:
        raise ValueError("; ".join(faults))
    return {**value, "folder": str(Path(path).parent), "fingerprint": digest(value)}


def load_profiles(folder: str | Path) -> dict[str, dict]:
    """Prompt profiles of a folder by id; a faulty one, an id given twice, or a folder without any is an error."""
    out: dict[str, dict] = {}
    for path in sorted(Path(folder).glob("*.json")):
        profile = json.loads(path.read_text(encoding="utf-8"))
        faults = clause_faults(profile)
        name = profile.get("profile_id")
        if name in out:
            faults.append(f"{name} is there already")
        if faults:
            raise ValueError(f"{path.name}: {'; '.join(faults)}")
        out[name] = profile
    if not out:
        raise ValueError(f"no prompt profiles in {folder}")
    return out


def clause_faults(profile: dict) -> list[str]:
    """Faults of a prompt profile: of its version and id, scenes without base prompt, clauses without a name of their own, without a
    place for the value, or without a precision."""
    out = [] if profile.get("schema_version", "1.0") == "1.0" else ["schema_version is not 1.0"]
    if "profile_id" in profile and not (isinstance(profile["profile_id"], str) and profile["profile_id"]):
        out.append("no profile_id")
    if not profile.get("scenes"):
        out.append("no scenes")
    for scene, held in sorted((profile.get("scenes") or {}).items()):
        if not str(held.get("base_prompt") or "").strip():
            out.append(f"{scene}: no base_prompt")
        clauses = held.get("parameter_clauses", [])
        if not isinstance(clauses, list):
            out.append(f"{scene}: clauses are no list")
            continue
        names = [c.get("name") for c in clauses]
        if not all(isinstance(n, str) and n for n in names) or len(names) != len(set(names)):
            out.append(f"{scene}: clauses without a name of their own")
        out += [f"{scene}/{c.get('name')}: no place for the value" for c in clauses if "{value}" not in str(c.get("template", "{value}"))]
        out += [f"{scene}/{c.get('name')}: no precision" for c in clauses if "precision" in c and (not isinstance(c["precision"], int) or isinstance(c["precision"], bool) or c["precision"] < 0)]
    return out
