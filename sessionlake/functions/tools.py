"""What a tool call was asked, read out of its JSON input, and the words that name the call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlake.functions.jsons import is_object, read_json
from sessionlake.functions.text import cut


def json_field(text: Column, field: str) -> Column:
    """One top-level member as text; NULL where the text is not a JSON object or lacks it."""
    return F.when(is_object(text), read_json(text, f"`{field}` STRING")[field])


def tool_asked(field: str, chars: int, source: Column | None = None) -> Column:
    return cut(json_field(F.col("input") if source is None else source, field), chars)


def tool_path(project_dir: Column, chars: int, path: Column | None = None) -> Column:
    """`file_path`, relative to the project where it lies inside it, cut after the prefix is off."""
    whole = json_field(F.col("input"), "file_path") if path is None else path
    inside = F.startswith(whole, F.concat(project_dir, F.lit("/")))
    return F.when(
        F.coalesce(inside, F.lit(False)),
        cut(F.substr(whole, F.length(project_dir) + 2), chars),
    ).otherwise(cut(whole, chars))


# The members a tool call may be named by.
ASKED = (
    "command", "description", "subagent_type", "skill", "args", "to", "summary", "pattern",
    "url", "query", "message",
)


def members(text: Column) -> Column:
    """All members in one reading of the input. To be a column of its own before they are taken from it:
    written into the expressions that use it, it is read again by each."""
    schema = ", ".join(f"`{name}` STRING" for name in (*ASKED, "file_path", "todos"))
    return F.when(is_object(text), read_json(text, schema))


def told(asked: Column, chars: int) -> Column:
    """What names are made from, no longer than they show it but for the path."""
    return F.struct(
        asked["file_path"].alias("file_path"),
        *[cut(asked[name], chars).alias(name) for name in ASKED],
        F.json_array_length(asked["todos"]).alias("todos"),
        cut(F.col("input"), chars).alias("input_head"),
    )


def tool_fields(said: Column, project_dir: Column, addressed: Column, chars: int) -> Column:
    return F.struct(
        tool_path(project_dir, chars, said["file_path"]).alias("path"),
        *[said[name].alias(name) for name in ASKED],
        cut(addressed, chars).alias("addressed"),
        said["todos"].alias("todos"),
        said["input_head"].alias("input_head"),
    )


def _word(fields: Column, name: str) -> Column:
    """A member that says something: NULL and empty both say nothing."""
    value = fields[name]
    return F.when(value != "", value)


# The one member each of these tools is named by.
NAMED_BY = {
    "Read": "path", "Write": "path", "Edit": "path", "Grep": "pattern", "Glob": "pattern",
    "WebFetch": "url", "WebSearch": "query", "ToolSearch": "query", "PushNotification": "message",
}


def tool_words(name: Column, fields: Column) -> Column:
    """A call's name: its tool's own rule first, else path, description or raw input head."""

    def word(member: str) -> Column:
        return _word(fields, member)

    said = F.coalesce(word("description"), F.lit(""))
    kind = word("subagent_type")
    who = F.coalesce(word("addressed"), word("to"))
    count = fields["todos"]
    rule = F
    for tool, member in NAMED_BY.items():
        rule = rule.when(name == tool, word(member))
    rule = (
        rule.when(
            name == "Bash",
            F.when(
                word("command").isNotNull(),
                F.coalesce(
                    word("description"), F.split_part(word("command"), F.lit("\n"), F.lit(1))
                ),
            ),
        )
        .when(
            name == "Agent",
            F.when(
                kind.isNotNull(), F.trim(F.concat(F.lit("["), kind, F.lit("] "), said))
            ).otherwise(word("description")),
        )
        .when(
            name == "Skill",
            F.trim(F.concat(word("skill"), F.lit(" "), F.coalesce(word("args"), F.lit("")))),
        )
        .when(
            name == "SendMessage",
            F.when(
                word("summary").isNotNull(),
                F.concat(F.lit("to "), who, F.lit(": "), word("summary")),
            ).otherwise(F.concat(F.lit("to "), who)),
        )
        .when(
            name == "TodoWrite",
            F.concat(
                count.cast("string"), F.when(count == 1, F.lit(" todo")).otherwise(F.lit(" todos"))
            ),
        )
    )
    shape = F.coalesce(fields["path"], fields["description"], fields["input_head"], F.lit(""))
    return F.coalesce(rule, shape)
