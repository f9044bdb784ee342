"""Vocabularies and constants of the naming law, and the gates' thresholds, as small tables."""

from __future__ import annotations

#: Words that no name may carry.
BANNED = ("content", "foreground", "label", "semantic", "surface")
#: Utility prefixes in which banned words are looked for.
PREFIXES_BANNED = ("via", "to", "text", "stroke", "shadow", "ring", "placeholder", "outline", "from", "fill", "divide", "border", "bg")
#: Utility prefixes whose name must begin with an owner.
PREFIXES_OWNER = ("text", "stroke", "shadow", "ring", "placeholder", "outline", "fill", "divide", "border", "bg")
#: The property that a prefix declares.
PREFIX_PROPERTY = {"stroke": "stroke", "fill": "fill", "outline": "outline-color", "border": "border-color", "bg": "background-color", "text": "color"}
#: The order in which a name's own property is looked for.
PROPERTY_ORDER = ("background-color", "border-color", "outline-color", "color")
#: Words in the owner's place that are pigments or keywords.
EXEMPT = tuple(sorted("none auto black white inherit current transparent rose pink fuchsia purple violet indigo sky cyan teal emerald lime orange yellow amber stone neutral zinc slate grey gray blue green red".split()))
OWNERS = tuple(
    sorted(
        "focus-ring divider empty-state skeleton toast banner avatar stat chart progress pill badge card list-row data-table citation attachment markdown code-block prompt chat-message search slider toggle radio checkbox select field button drawer tooltip overlay modal menu popover logo toolbar workspace-item thread-item nav-item sidebar page".split()
    )
)
ANATOMY = tuple(sorted("handle suffix prefix helper placeholder caret divider backdrop cell row header indicator thumb track icon text container".split()))
PROPERTIES = tuple(sorted("stroke fill box-shadow outline-color border-color color background-color column-gap row-gap gap margin padding border-radius letter-spacing line-height font-weight".split()))
VARIANTS = tuple(sorted("info warning success destructive ghost secondary primary".split()))
STATES = tuple(sorted("loading off on invalid checked selected disabled focus active hover default".split()))
#: The property that an anatomy implies, which is then not written.
IMPLIED = {"divider": "border-color", "backdrop": "background-color", "caret": "color", "helper": "color", "placeholder": "color", "text": "color"}
#: Words that say where a name is used, not what it is.
CONTEXT_WORDS = (*BANNED, "default", "static")
NAME_POINTS = {"owner": 30, "no_context": 25, "no_redundant": 15, "coherent": 10, "state_has_base": 10, "nothing_outside": 10}
NAME_CUT = 70
#: Fusion of contracts: points by criterion, the colour difference that no eye sees, and the outlier's measures.
FUSION = {"colour": 40.0, "contract": 25.0, "component": 15.0, "owner": 10.0, "function": 10.0}
IMPERCEPTIBLE, CLEAR = 2.3, 5.0
OUTLIER_USES, OUTLIER_SHARE = 2, 0.25
CONTRAST_TEXT, CONTRAST_OTHER = 4.5, 3.0
WHITES = ("#f8f8f2", "#fafafa", "#fffbeb", "#ffffff")
IMMUTABLE = ("runId", "batchId", "matrixFingerprint", "toolchainFingerprint", "routeRegistryFingerprint", "fixtureRegistryFingerprint")
WAIVABLE = ("fixtureRegistryFingerprint",)
FINGERPRINTS = ("sourceFingerprint", "worktreeFingerprint", "toolchainFingerprint", "tokenSourceFingerprint", "generatedCssFingerprint", "routeRegistryFingerprint", "fixtureRegistryFingerprint")
_HUES = "red|orange|amber|yellow|lime|green|emerald|teal|cyan|sky|blue|indigo|violet|purple|fuchsia|pink|rose"
_PAINT = "stroke|fill|to|via|from|ring|border|text|bg"
#: Hard-coded style: dimension, what counts a line, what takes it out again. Java and RE2 both read these.
HARDCODE = (
    ("color-gray", rf"(^|[^a-z-])({_PAINT}|divide)-(stone|neutral|zinc|slate|gray)-(50|[1-9]00|950)", None),
    ("color-hex", r"#[0-9A-Fa-f]{6}\b|#[0-9A-Fa-f]{3}\b|rgba?\([0-9]", r"(?i)rgba?\(\s*(0\s*,\s*0\s*,\s*0|255\s*,\s*255\s*,\s*255)|rgb\(\s*(0\s+0\s+0|255\s+255\s+255)"),
    ("color-named", rf"({_PAINT})-({_HUES})-[0-9][0-9][0-9]?", None),
    ("color-wb", rf"({_PAINT})-(black|white)([^a-z0-9/\[-]|$)", None),
    ("motion", r"(ease|duration)-\[", r"var\(--"),
    ("radius-shadow", r"rounded(-[a-z]+)?-\[|shadow-\[|ring-\[[0-9]|border(-[a-z]+)?-\[[0-9]", r"var\(--"),
    ("spacing-rhythm", r"(^|[^a-z-])(gap|space-[xy]|[pm][xytrbl]?)-\[[0-9][^\]]*(rem|px)\]", None),
    ("typography-px", r"text-\[[.0-9]+px\]", None),
    ("zindex", r"z-\[[0-9]+\]|(^|[^a-z-])z-[0-9][0-9]+", r"z-\(--z-"),
)
PROJECTS = (("desktop", 1440, 900), ("mobile-md", 390, 844), ("mobile-sm", 360, 740), ("tablet", 768, 1024))
THEMES = ("dark", "light")
