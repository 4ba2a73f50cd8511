"""Row types of the tables that operators exchange."""

BLOCK = (
    "path string, ord int, id string, env string, kind string, title string, label string, text string, section string, line int, proof_of string, "
    "refs array<string>, cites array<string>, math array<string>, uses array<string>, declared_lean array<string>, lean_ok boolean"
)
DECLARATION = "name string, kind string, module string, line int, doc string, head string, namespace string, attrs string, provenance string"
DUMP = "name string, module string, kind string, type string"
PAIR = "text string, title string, targets array<string>, math array<string>, project string, id string"
TASK = "id string, arm string, corpus string, title string, text string, section string, gold array<string>"
PREDICTION = "id string, prediction string"
