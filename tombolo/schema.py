"""Row types of the engine, as DDL, and the fixed texts of the command language."""

#: ``seq`` is unique and gives the total order; ``value`` is null for a tombstone alone.
CHANGE = "seq long, op string, key string, value string"
SEGMENT = "segment_id long, seq long, op string, key string, value string"
LINE = "session string, seq long, line string"

#: The verbs of each command, the error texts and the help text.
VERBS = {
    "set": ("set", "s"),
    "get": ("get", "g"),
    "delete": ("delete", "del", "d"),
    "quit": ("quit", "q", "exit"),
    "help": ("help", "h"),
}
#: Words that a command has, its verb among them; the others take any number.
WORDS = {"set": 3, "get": 2, "delete": 2}
UNRECOGNIZED = "unrecognized command"
MISSING = "missing required arguments"
TOO_MANY = "too many arguments"
