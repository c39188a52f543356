"""What a command is, read from its text: class, context and fixed advice.

Every answer is one CASE expression, so classifying a table is a projection
with no join and no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlog_spark.functions.text import first_word

# Class of a command by its lower-case first word.
TYPE_WORDS = {
    "git": ["git"],
    "docker": ["docker"],
    "kubectl": ["kubectl", "kubectx", "kubens"],
    "make": ["make"],
    "cargo": ["cargo"],
    "npm": ["npm"],
    "yarn": ["yarn"],
    "python": ["python", "python3", "pip", "pip3"],
    "go": ["go", "gofmt", "goimports"],
    "navigation": ["cd", "ls", "pwd", "find", "grep", "mkdir", "rm", "cp", "mv"],
    "system": ["ps", "top", "htop", "df", "du", "free", "uptime", "whoami", "id", "uname"],
}
GENERIC = "generic"

# Fixed values: (keyword, text) per class, first keyword found wins; the empty
# keyword is the text of the class itself.
CONTEXT_RULES = {
    "git": [
        ("status", "Shows working directory status and changes"),
        ("commit", "Records changes to repository"),
        ("push", "Uploads local commits to remote"),
        ("pull", "Downloads and integrates remote changes"),
        ("", "Git version control operation"),
    ],
    "docker": [
        ("build", "Builds image from Dockerfile"),
        ("run", "Creates and starts new container"),
        ("ps", "Lists running containers"),
        ("", "Docker container management"),
    ],
    "cargo": [
        ("build", "Compiles the current package"),
        ("test", "Runs package tests"),
        ("run", "Builds and runs the current package"),
        ("", "Rust package management"),
    ],
    "npm": [
        ("install", "Installs package dependencies"),
        ("start", "Starts the application"),
        ("test", "Runs test suite"),
        ("", "Node.js package management"),
    ],
    "make": [
        ("clean", "Removes build artifacts"),
        ("test", "Runs test suite"),
        ("install", "Installs project files"),
        ("", "Builds project targets"),
    ],
}

# Fixed values: (keywords, suggested commands) per class, first rule with a
# keyword in the command wins; the empty keyword always matches.
SUGGESTION_RULES = {
    "git": [
        (["commit"], ["git status", "git log --oneline", "git push"]),
        (["push"], ["git status", "git log --oneline -5", "git pull"]),
        (["pull", "fetch"], ["git status", "git log --oneline -5", "git merge"]),
        (["branch"], ["git checkout", "git branch -a"]),
        (["checkout", "switch"], ["git status", "git branch"]),
    ],
    "docker": [
        (["build"], ["docker images", "docker run", "docker ps -a"]),
        (["run"], ["docker ps", "docker logs", "docker stop"]),
        (["ps"], ["docker logs", "docker exec"]),
    ],
    "cargo": [
        (["build"], ["cargo run", "cargo test", "cargo check"]),
        (["test"], ["cargo build", "cargo run"]),
        (["run"], ["cargo build", "cargo test"]),
    ],
    "npm": [
        (["install"], ["npm start", "npm run build", "npm test"]),
        (["start"], ["npm run build", "npm test"]),
    ],
    "make": [([""], ["make clean", "make install", "make test"])],
}


def command_type(cmd: Column) -> Column:
    word = first_word(F.lower(cmd))
    pairs = [(w, kind) for kind, words in TYPE_WORDS.items() for w in words]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.element_at(table, word), F.lit(GENERIC))


def command_context(cmd: Column) -> Column:
    """One line on what the command does; null for classes without rules."""
    kind = command_type(cmd)
    result = F.lit(None).cast("string")
    for name, rules in reversed(CONTEXT_RULES.items()):
        text = F.lit(None).cast("string")
        for keyword, answer in reversed(rules):
            text = F.when(cmd.contains(keyword), answer).otherwise(text)
        result = F.when(kind == name, text).otherwise(result)
    return result


def semantic_suggestions(cmd: Column) -> Column:
    """Commands that usually follow, as an array; empty without a rule."""
    kind = command_type(cmd)
    nothing = F.array().cast("array<string>")
    result = nothing
    for name, rules in reversed(SUGGESTION_RULES.items()):
        advice = nothing
        for keywords, commands in reversed(rules):
            hit = F.lit(False)
            for keyword in keywords:
                hit = hit | cmd.contains(keyword)
            advice = F.when(hit, F.array(*map(F.lit, commands))).otherwise(advice)
        result = F.when(kind == name, advice).otherwise(result)
    return result
