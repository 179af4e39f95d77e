"""Language names by file name and extension."""

from __future__ import annotations

# The extensions of each language.
EXTENSIONS = {
    "ABAP": [".abap"], "Ada": [".adb", ".ads"], "Go-Zero API": [".api"], "Apex": [".apex"], "Astro": [".astro"], "ASP.NET": [".aspx"], "Awk": [".awk"],
    "PHP": [".php", ".php4", ".php5", ".phtml"], "Twig": [".twig"], "Go": [".go"], "Java": [".java"], "JSP": [".jsp"], "JavaScript": [".js", ".mjs", ".cjs", ".jsx"],
    "TypeScript": [".ts", ".mts", ".cts", ".tsx"], "Vue": [".vue"], "Svelte": [".svelte"], "Python": [".py", ".pyw"], "Jupyter Notebook": [".ipynb"], "XML": [".xml"],
    "YAML": [".yaml", ".yml"], "TOML": [".toml"], "INI": [".ini"], "Config": [".conf", ".cfg"], "Properties": [".properties"], "SQL": [".sql"], "CSS": [".css"], "SCSS": [".scss"],
    "Sass": [".sass"], "Less": [".less"], "HTML": [".html", ".htm"], "Razor": [".cshtml", ".razor"], "JSON": [".json", ".jsonc"], "Markdown": [".md"], "MDX": [".mdx"], "Text": [".txt"],
    "Shell": [".sh", ".bash", ".zsh"], "Batch": [".bat", ".cmd"], "PowerShell": [".ps1"], "GraphQL": [".graphql", ".gql"], "Protocol Buffers": [".proto"], "Thrift": [".thrift"],
    "Ruby": [".rb", ".rake"], "ERB": [".erb"], "Rust": [".rs"], "C": [".c", ".h"], "C++": [".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"], "MATLAB": [".m"], "Objective-C++": [".mm"],
    "C#": [".cs"], "F#": [".fs", ".fsi", ".fsx"], "Visual Basic": [".NET", ".vb"], "Swift": [".swift"], "Kotlin": [".kt", ".kts"], "Dart": [".dart"], "Lua": [".lua"], "R": [".r"],
    "Scala": [".scala"], "Elixir": [".ex", ".exs"], "Erlang": [".erl", ".hrl"], "Haskell": [".hs"], "Clojure": [".clj", ".cljs"], "Groovy": [".groovy"], "Gradle": [".gradle"],
    "Perl": [".pl", ".pm", ".t"], "F# Project": [".fsproj"], "VB.NET Project": [".vbproj"], "C# Project": [".csproj"], "Visual Studio Solution": [".sln"],
    "HCL": [".tf", ".tfvars", ".hcl"], "Solidity": [".sol"], "Zig": [".zig"], "Nim": [".nim"], "Crystal": [".cr"], "Elm": [".elm"], "Julia": [".jl"], "Arduino": [".ino"],
    "Verilog": [".v"], "SystemVerilog": [".sv"], "VHDL": [".vhd", ".vhdl"],
}
# The file names, in lower case, of each language.
NAMES = {
    "JSON": [".babelrc", ".eslintrc", ".prettierrc"], "Dockerfile": [".dockerignore", "dockerfile"], "EditorConfig": [".editorconfig"], "Env": [".env"], "Text": [".eslintignore"],
    "Git Config": [".gitattributes", ".gitignore"], "Config": [".npmrc"], "Bazel": ["build", "workspace"], "CMake": ["cmakelists.txt"],
    "Ruby": ["fastfile", "gemfile", "guardfile", "podfile", "rakefile", "vagrantfile"], "Groovy": ["jenkinsfile"], "Just": ["justfile"], "Makefile": ["makefile"], "Elixir": ["mix.exs"],
    "Swift": ["package.swift"], "Procfile": ["procfile"],
}
# The shorter map used for histories.
HISTORY_EXTENSIONS = {
    "PHP": [".php"], "Go": [".go"], "Java": [".java"], "Kotlin": [".kt"], "TypeScript": [".ts", ".tsx"], "JavaScript": [".js", ".jsx"], "Vue": [".vue"], "Python": [".py"],
    "C#": [".cs"], "C++": [".cpp"], "C": [".c"], "Rust": [".rs"], "SQL": [".sql"],
}


def _by(table: dict[str, list[str]]) -> dict[str, str]:
    return {key: language for language, keys in table.items() for key in keys}


BY_EXTENSION, BY_NAME, HISTORY = _by(EXTENSIONS), _by(NAMES), _by(HISTORY_EXTENSIONS)
