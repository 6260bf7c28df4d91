"""What diagnostics say. Codes and places are what programs go by."""

# Texts that published results have.
REPEATED = "duplicate '{}' attribute; first value wins"
LONE_AMPERSAND = "dangling '&' without a terminating ';' is not a well-formed entity reference; kept as literal text"
MISSING_ID = "{} is missing an id attribute"
DANGLING = '<include refid="{}"> has no matching <sql> fragment in this file'
TOO_DEEP = "dynamic-tag nesting exceeds the depth cap of {}; remaining subtree treated as opaque (no text contribution)"
TOO_MANY = "branch combinations ({}+) exceed the cap of {}; falling back to a union of all branch text"
UNKNOWN_TAG = "unrecognized element <{}> in dynamic position -- not a known MyBatis/iBatis dynamic tag, and not one of this crate's known-ignorable elements; its content is still folded in transparently (possible typo?)"
UNKNOWN_CHILD = "unrecognized statement-level element <{}> -- not a known statement/fragment/resultMap tag, and not one of this crate's known-ignorable elements; ignored (possible typo?)"
BOUNDARY = "<include> is the first or last non-whitespace content inside <{0}> -- since <include> expands before dynamic evaluation in MyBatis/iBatis, re-apply {0}'s leading AND/OR or trailing-comma rule to the substituted fragment text (a wrapper whose only content is this include must be treated as conditional)"
DECLARED = "declared encoding '{}' does not match the actual encoding ({}); using {}"

# Our own.
NO_REFID = "an include names no fragment: it has no refid"
KEY_IN_FRAGMENT = "a selectKey belongs into a statement; in a fragment it is left out"
MAP_TOO_DEEP = "result map nested {} levels deep; what lies deeper is not read"
NO_ROOT = "the document has no element"
OTHER_ROOT = "the root <{}> is neither mapper nor sqlMap"
OTHER_BRANCH = "<{}> in a choose is left out: only when and otherwise count"
NO_ENCODING = "no encoding fits all bytes: neither UTF-8, nor what is declared, nor EUC-KR; bytes that do not fit UTF-8 are replaced"
