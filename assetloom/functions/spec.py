"""Table specifications as data: column name, kind, closed domain, default, and whether a template fills it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "string"  # string, int, float, boolean, level, or a key of DOMAINS
    default: str | None = None
    inherited: bool = True
    written: bool = True


# Closed domains.
DOMAINS = {
    "behavior": ["DEFAULT", "ASR"],
    "storage": ["LOADED", "STREAMED", "PRIMED"],
    "bus": [
        "BUS_FX", "BUS_VOICE", "BUS_PFUTZ", "BUS_HDRFX", "BUS_UI", "BUS_MUSIC", "BUS_MOVIE", "BUS_REFERENCE", "BUS_LICENSE",
        "BUS_NEARVERB_SEND", "BUS_NEARVERB_WORK", "BUS_NEARVERB_RETURN", "BUS_FARVERB_SEND", "BUS_FARVERB_WORK", "BUS_FARVERB_RETURN",
        "BUS_EARLYVERB_SEND", "BUS_EARLYVERB_WORK", "BUS_EARLYVERB_RETURN",
    ],
    "limit": ["NONE", "OLDEST", "REJECT", "PRIORITY"],
    "looping": ["LOOPING", "NONLOOPING"],
    "flux": ["NONE", "LEFT_PLAYER", "CENTER_PLAYER", "RIGHT_PLAYER", "RANDOM_PLAYER", "LEFT_SHOT", "CENTER_SHOT", "RIGHT_SHOT", "RANDOM_DIRECTION"],
}
LEVELS = ["none", "low", "medium", "high", "extreme"]


def _columns(text: str, **options) -> list[ColumnSpec]:
    """One column a line: name, kind, default (after =)."""
    out = []
    for line in text.strip().splitlines():
        head, _, default = line.partition("=")
        name, _, kind = head.strip().partition(" ")
        out.append(ColumnSpec(name, kind.strip() or "string", default.strip() or None, **options))
    return out


# The alias table in the order in which it is written, with the defaults that follow inheritance.
_ALIAS = """
Behavior behavior = DEFAULT
Storage storage = LOADED
FileSpec
FileSpecSustain
FileSpecRelease
Template
Loadspec
Secondary
SustainAlias
ReleaseAlias
Bus bus = BUS_FX
VolumeGroup
DuckGroup
Duck
ReverbSend int = 0
CenterSend int = 0
VolMin int = 92
VolMax int = 92
DistMin int = 0
DistMaxDry int = 10000
DistMaxWet int
DryMinCurve string = allon
DryMaxCurve string = default
WetMinCurve string = allon
WetMaxCurve string = default
LimitCount int = 8
LimitType limit = PRIORITY
EntityLimitCount int = 8
EntityLimitType limit = OLDEST
PitchMin int = 0
PitchMax int = 0
PriorityMin int = 100
PriorityMax int = 100
PriorityThresholdMin float = 0.25
PriorityThresholdMax float = 0.75
AmplitudePriority boolean = false
PanType string = 2d
Pan string = default
Futz boolean = false
Looping looping = NONLOOPING
RandomizeType
Probability float = 1.0
StartDelay int = 0
EnvelopMin int = 0
EnvelopMax int = 0
EnvelopPercent int = 0
OcclusionLevel float = 0.25
IsBig boolean = false
DistanceLpf boolean = true
FluxType flux = NONE
FluxTime int = 0
Subtitle
Doppler boolean = false
ContextType
ContextValue
ContextType1
ContextValue1
ContextType2
ContextValue2
ContextType3
ContextValue3
Timescale boolean = false
IsMusic boolean = false
IsCinematic boolean = false
FadeIn int = 0
FadeOut int = 0
Pauseable boolean = true
StopOnEntDeath boolean = false
Compression int = 100
CompressionLevel level
StopOnPlay
DopplerScale float = 1.0
FutzPatch
VoiceLimit boolean = false
IgnoreMaxDist boolean = false
NeverPlayTwice boolean = false
ContinuousPan boolean = true
FileSource
FileSourceSustain
FileSourceRelease
FileTarget
FileTargetSustain
FileTargetRelease
Platform
Language
OutputDevices
PlatformMask
WiiUMono boolean = false
StopAlias
DistanceLpfMin int = 800
DistanceLpfMax int = 3000
FacialAnimationName
RestartContextLoops boolean = false
SilentInCPZ boolean = false
ContextFailsafe boolean = false
GPAD boolean = false
GPADOnly boolean = false
MuteVoice boolean = false
MuteMusic boolean = false
"""
_PROVENANCE = """
RowSourceFileName
RowSourceShortName
RowSourceLineNumber int
"""
ALIAS = [
    ColumnSpec("Name", inherited=False),
    *[
        ColumnSpec(c.name, c.kind, c.default, inherited=c.name != "Template", written=c.name != "CompressionLevel")
        for c in _columns(_ALIAS)
    ],
    *_columns(_PROVENANCE, inherited=False),
]
REVERB = _columns(
    """
Name
MasterReturn int
EarlyInputLpf float
EarlyFeedback float
EarlySmear float
EarlyBaseDelayMs int
EarlyPreDelayMs int
EarlyReturn int
NearInputLpf float
NearFeedback float
NearReturn float
NearLowDamp float
NearHighDamp float
NearDecayTime float
NearSmear float
NearPreDelayMs int
FarInputLpf float
FarFeedback float
FarReturn float
FarLowDamp float
FarHighDamp float
FarDecayTime float
FarSmear float
FarPreDelayMs int
"""
    + _PROVENANCE
)
AMBIENT = _columns(
    """
Name
DefaultRoom boolean = false
Reverb string = default
ReverbDryLevel float = 1.0
ReverbWetLevel float = 1.0
Loop
Duck string = default
EntityContextType0
EntityContextValue0
EntityContextType1
EntityContextValue1
EntityContextType2
EntityContextValue2
GlobalContextType
GlobalContextValue
"""
    + _PROVENANCE
)
SCRIPT_ID = _columns("ScriptId\nAliasName\n" + _PROVENANCE)
PLATFORM = _columns("Platform\nConvertedAssetVersion int\nConvertThreadCount int\nCompressionScale float")
LOCALE = _columns("Name\nSearchName\nDeployName\nCacheName\nIsShared boolean\nCompressionScale float")

CONTEXT = [f"Context{kind}{i}" for i in ("", "1", "2", "3") for kind in ("Type", "Value")]
SPECS = ["FileSpec", "FileSpecSustain", "FileSpecRelease"]
#: Keys of keep-first de-duplication and of the order of the written table.
DEDUP_KEYS = ["Name", *SPECS, *CONTEXT]
SORT_KEYS = ["Name", "FileSpec", "FileTarget", *CONTEXT, "Template"]
GENERATED = [*[f"FileSource{s}" for s in ("", "Sustain", "Release")], *[f"FileTarget{s}" for s in ("", "Sustain", "Release")]]
#: Pairs (a, b) with a <= b where both are given.
ORDERED_PAIRS = [
    ("DistMin", "DistMaxDry"),
    ("DistMin", "DistMaxWet"),
    ("DistMaxDry", "DistMaxWet"),
    ("PitchMin", "PitchMax"),
    ("EnvelopMin", "EnvelopMax"),
    ("VolMin", "VolMax"),
    ("PriorityThresholdMin", "PriorityThresholdMax"),
]
