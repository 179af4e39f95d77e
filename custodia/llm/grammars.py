"""Local grammars: what may stand between two matching brackets.

Once brackets match, each pair is one symbol, and the content of a pair is a word over symbols, one for
each class of token. A grammar says which words a block, an argument list or a class body may be. Each is
a set of rules in the notation of regular expressions with named rules; a word is looked up once.

A token is first written as a code that does not depend on what stands around it: ``\\n`` if it is the first on
its line (in Python with its margin), a symbol, and its text where that matters. ``word_of`` makes a word of the
codes of one content.
"""

from __future__ import annotations

import functools

import regex

from custodia.llm.lexing import SCRIPTS, Token
from custodia.llm.recognise import matches

# Symbols of all languages: i name, n number, s string, r pattern, P () B [] C {} X ${}, = assigning, a plus or minus, u ++ or --,
# ! not, o other operator between two values, L < G >, A arrow, e ..., and . : ? ; , * & | @ ~ themselves.
_OPERATORS = {"+": "a", "-": "a", "++": "u", "--": "u", "!": "!", "~": "!", "<": "L", ">": "G", "=>": "A", "...": "e", "?.": ".", "?->": ".", ".": ".", "=": "=", ":=": "="}
_KEPT = ".:?;,*&|@\\#"
_OPEN = {"(": "P", "[": "B", "{": "C", "${": "X"}


def _words(table: str) -> dict[str, str]:
    return {word: entry.split("=")[0] for entry in table.split() for word in entry.split("=")[1].split(",")}


# The key words of each language by symbol.
WORDS = {
    "JavaScript": _words("I=if E=else F=for W=while D=do S=switch K=case d=default T=try H=catch Y=finally R=return t=throw J=break,continue f=function c=class x=extends v=const,let,var m=import q=export p=new,typeof,void,delete,await,yield o=in,instanceof,of y=async g=static,get,set"),
    "TypeScript": _words("I=if E=else F=for W=while D=do S=switch K=case d=default T=try H=catch Y=finally R=return t=throw J=break,continue f=function c=class x=extends h=implements v=const,let,var m=import q=export p=new,typeof,void,delete,await,yield,keyof,infer,unique o=in,instanceof,of,is y=async g=static,get,set w=public,private,protected,readonly,abstract,override,declare z=interface,namespace,module,enum,type j=as,satisfies"),
    "Java": _words("I=if E=else F=for W=while D=do S=switch K=case d=default T=try H=catch Y=finally R=return,yield t=throw,assert J=break,continue c=class,interface,enum,record x=extends U=super h=implements,permits,throws m=import k=package p=new w=public,private,protected,static,final,abstract,synchronized,native,transient,volatile,strictfp,sealed O=instanceof"),
    "Go": _words("I=if E=else F=for S=switch,select K=case d=default R=return J=break,continue,goto,fallthrough f=func v=var,const z=type t=struct,interface m=import k=package g=go,defer M=map N=chan l=range"),
    "PHP": _words("I=if,elseif E=else F=for,foreach W=while D=do S=switch,match,declare K=case d=default T=try H=catch Y=finally R=return,echo,print,break,continue,yield,goto t=throw f=function l=fn c=class,interface,trait,enum x=extends h=implements m=use k=namespace v=const,global p=new,clone,include,require,include_once,require_once w=public,private,protected,static,final,abstract,readonly,var j=as,insteadof o=instanceof,and,or,xor"),
}
WORDS["Python"] = _words("I=if E=else Q=elif W=while f=for T=try X=except Y=finally h=with d=def c=class l=lambda R=return t=raise A=assert D=del J=break,continue p=pass G=global,nonlocal m=import F=from j=as y=async v=await N=yield q=in k=is o=and,or !=not n=None,True,False")
_PYTHON = r"""
(?<expr>l(?:(?&lparam)(?:,(?&lparam))*+,?)?:(?&expr)|(?&or)(?:I(?&or)E(?&expr))?+)
(?<lparam>(?:\*|S)i|\*|/|i(?:=(?&expr))?)
(?<or>(?&un)(?:(?:[oa*S@/q]|!q|k!?)(?&un))*+)
(?<post>\.i|[PuBx])
(?<un>(?:[a~!v])*+(?&prim)(?&post)*+)
(?<prim>[inPBCb]|s++)
(?<named>iw(?&expr)|(?&expr))
(?<item>\*(?&or)|(?&expr))
(?<some>(?:\*(?&or)|(?&named))(?:,(?:\*(?&or)|(?&named)))*+,?)
(?<seq>(?&item)(?:,(?&item))*+,?)
(?<value>N(?:F(?&expr)|(?&seq)?)|(?&seq))
(?<target>\*?(?&prim)(?&post)*+)
(?<targets>(?&target)(?:,(?&target))*+,?)
(?<comp>(?:y?f(?&targets)q(?&or)(?:I(?:l(?&expr)|iw(?&or)|(?&or)))*+)++)
(?<single>(?&prim)(?&post)*(?:\.i|[Bx])|i|P)
(?<tgt>\*?(?:(?&single)|[Bb]))
(?<tgts>(?&tgt)(?:,(?&tgt))*+,?)
(?<dotted>i(?:\.i)*+)
(?<simple>R(?&seq)?|t(?:(?&expr)(?:F(?&expr))?)?|A(?&expr)(?:,(?&expr))?|D(?&targets)|[Jp]|Gi(?:,i)*+|m(?&dotted)(?:ji)?(?:,(?&dotted)(?:ji)?)*+|F(?:[.n]++(?&dotted)?|(?&dotted))m(?:\*|[Pr]|i(?:ji)?(?:,i(?:ji)?)*+)|zi[Bx]?=(?&expr)|(?&single):(?&expr)(?:=(?&value))?|(?&single)g(?&value)|(?:(?&tgts)=)*+(?&value))
(?<with>r|(?&expr)(?:j(?&target))?)
(?<pat>\*?(?:(?&dotted)?r|(?&or))(?:ji)?)
(?<head>[IQW](?&named)|[ETY]|y?f(?&targets)q(?&seq)|X\*?(?:(?&expr)(?:ji)?)?|y?h(?&with)(?:,(?&with))*+|y?di[Bx]?[Pur](?:>(?&expr))?|ci[Bx]?[Pu]?|M(?&some)|K(?&pat)(?:,(?&pat))*+,?(?:I(?&named))?)
(?<line>(?&simple)(?:;(?&simple))*+;?|(?&head):(?:(?&simple)(?:;(?&simple))*+;?)?|@(?&named))
(?<arg>(?:\*|S)(?&expr)|i=(?&expr)|(?&named)(?&comp)?)
(?<args>(?:(?&arg)(?:,(?&arg))*+,?)?)
(?<group>(?:(?&named)(?&comp)|N(?:F(?&expr)|(?&seq)?)|(?&some))?)
(?<param>(?:\*|S)i(?::\*?(?&expr))?|\*|/|i(?::(?&expr))?(?:=(?&expr))?)
(?<params>(?:(?&param)(?:,(?&param))*+,?)?)
(?<names>i(?:ji)?(?:,i(?:ji)?)*+,?)
(?<withs>(?&with)(?:,(?&with))*+,?)
(?<pats>(?:i=)?(?:\*|S)?(?&or)(?:ji)?(?:,(?:i=)?(?:\*|S)?(?&or)(?:ji)?)*+,?)
(?<slice>(?&expr)?:(?&expr)?(?::(?&expr)?)?|(?:\*|S)(?&or)|(?&named)(?:=(?&expr))?|i:(?&expr)=(?&expr))
(?<index>(?&slice)(?:,(?&slice))*+,?)
(?<list>(?:(?&named)(?&comp)|(?&some)|(?&pats))?)
(?<pair>S(?&or)|(?&expr):(?&expr)(?:ji)?)
(?<dict>(?:(?&expr):(?&expr)(?&comp)|(?&pair)(?:,(?&pair))*+,?)?)
"""
_SCRIPT = r"""
(?<seq>(?&expr)(?:,(?&expr))*+)
(?<expr>(?&un)(?:(?:j(?&type)|(?:[oa=L*&|@]|G{1,3}=?)(?&un)|\?(?&expr):(?&expr)))*+)
(?<un>(?:p\*?|[!au]|L(?&type)G(?=[iP]))*+(?&prim)(?&post)*+u?+)
(?<prim>(?&arrow)|(?&func)|c(?&ident)?+(?&heads)C|[nrBC]|P|s(?:Xs?)*+|m(?=[P.])|(?&ident))
(?<arrow>y?+(?:(?&targs)?P(?::(?&type))?|(?&ident))A(?:C(?![.PB])|(?&expr)))
(?<func>y?f\*?(?&ident)?(?&targs)?P(?::(?&type))?C)
(?<post>P|B|s(?:Xs?)*+|\.(?:(?&ident)|P|B)|!(?![=a-zA-Z])|(?&targs)(?=P))
(?<ident>[iygwzjo#])
(?<heads>(?&targs)?(?:x(?&un)(?&targs)?)?(?:h(?&type)(?:,(?&type))*)?)
(?<type>[|&]?(?&ty)(?:[|&](?&ty))*+(?:x(?&type)\?(?&type):(?&type))?+)
(?<ty>(?:p(?&ty)?+|(?:[wg]|a)*(?:(?&targs)?P(?:A(?&type))|P|(?:m P)?(?&ident)(?:\.(?&ident))*+(?&targs)?|[sn](?:Xs?)*|C|B))B*+(?:o(?&type))?)
(?<targs>L(?&targ)(?:,(?&targ))*,?G)
(?<targ>(?:v|[|&])?(?&type)(?:x(?&type))?(?:=(?&type))?)
(?<end>;|(?=E|$))
(?<decl>v(?&target)(?:=(?&expr))?(?:,(?&target)(?:=(?&expr))?)*)
(?<target>(?:(?&ident)|B|C)!?(?::(?&type))?)
(?<deco>@(?&ident)(?:\.(?&ident))*P?;?)
(?<st>;|C|IP(?&st);?(?:E(?&st))?|Fp?P(?&st)|WP(?&st)|D(?&st)WP;?|SPC|TC(?:;?H(?:P)?C;?(?:YC)?|;?YC)|[Rt](?&seq)?(?&end)|J(?&ident)?(?&end)|(?:w)?(?&decl)(?&end)|(?:w)?(?&funcst)|(?&deco)*(?:[w])*c(?&ident)(?&heads)C|(?&imp)|(?&exp)|(?&named)|(?&ident):(?&st)|(?![C])(?&seq)(?&end))
(?<funcst>y?f\*?(?&ident)(?&targs)?P(?::(?&type))?(?:C|(?&end)))
(?<imp>m(?:z)?(?:s|(?&ident)=(?&un)|(?:(?:(?&ident)|C|\*j(?&ident)|\*i i)(?:,(?:C|\*j?i?(?&ident)))?)is)(?:iC)?(?&end))
(?<exp>q(?:d(?:(?:w)*c(?&ident)?(?&heads)C|y?f\*?(?&ident)?(?&targs)?P(?::(?&type))?C|(?&expr)(?&end))|=(?&expr)(?&end)|z?C(?:is)?(?&end)|\*(?:[ij](?&ident))?is(?&end)|(?=[vyfcwz@])(?&st)))
(?<named>w?(?:v)?z(?:(?&ident)|s)(?:\.(?&ident))*(?&targs)?(?:(?:x(?&type)(?:,(?&type))*)?C|=(?&type)(?&end)))
(?<block>(?&st)*+)
(?<switch>(?:(?:K(?&seq)|d):(?&block))*+)
(?<args>(?:e?(?&expr)(?:,e?(?&expr))*,?)?)
(?<list>(?:,|e?(?&expr)(?:,+|$))*+)
(?<param>(?&deco)*[w]*e?(?:(?&ident)|B|C)\??(?::(?&type))?(?:=(?&expr))?)
(?<params>(?:(?&param)(?:,(?&param))*,?)?)
(?<loop>(?:(?&decl)|(?&seq))?;(?&seq)?;(?&seq)?|v?(?&target)o(?&seq))
(?<key>(?:[a-zA-Z#](?<![PCXL]))|[nsB])
(?<object>(?:(?:e(?&expr)|[gy]*\*?(?&key)P C|(?&key):(?&expr)|(?&ident)(?:=(?&expr))?)(?:,|$))*+)
(?<class>(?:;|(?&deco)|[wg]+C|(?:[wgy]*)\*?(?&key)[?!]?(?:(?&targs)?P(?::(?&type))?(?:C|;|$)|(?::(?&type))?(?:=(?&expr))?(?:;|$)))*+)
(?<body>(?:(?:[wga]*(?&key)?[?a]*\??(?:(?&targs)?P)?(?::(?&type))?)(?:[;,]+|$))*+)
(?<names>(?:z?[a-zA-Zs](?:[ij][a-zA-Zs])?(?:,|$))*+)
(?<enum>(?:(?&key)(?:=(?&expr))?(?:,|$))*+)
"""
_UNTYPED = regex.sub(r"\(\?:L\(\?&type\)G\(\?=\[iP\]\)\)|\|L\(\?&type\)G\(\?=\[iP\]\)|\|j\(\?&type\)|j\(\?&type\)\|", "", _SCRIPT)
_UNTYPED = _UNTYPED.replace("(?&targs)?", "").replace("(?::(?&type))?", "").replace("|(?&targs)(?=P)", "").replace("|!(?![=a-zA-Z])", "").replace("(?<key>", "(?<key>")
_PLAIN_RULES = "\n".join(line for line in _UNTYPED.split("\n") if not line.startswith(("(?<type>", "(?<ty>", "(?<targs>", "(?<targ>", "(?<named>", "(?<body>", "(?<enum>", "(?<heads>")))
_PLAIN_RULES = _PLAIN_RULES.replace("(?&heads)", "(?:x(?&un))?").replace("|(?&named)", "")
_JAVA = r"""
(?<name>i(?:\.i)*+)
(?<type>(?&anno)*i(?&targs)?(?:\.i(?&targs)?)*+B*+e?)
(?<targs>L(?:(?&targ)(?:,(?&targ))*+)?G)
(?<targ>(?:\?|(?&type))(?:[xU](?&type)(?:&(?&type))*)?)
(?<anno>@(?&name)P?)
(?<mods>(?:w|d(?!:|A)|(?&anno))*+)
(?<expr>(?&un)(?:O(?&mods)(?&type)(?:i|P)?|(?:[oa=L*&|]|G{1,3}=?)(?&un)|\?(?&expr):(?&expr))*+)
(?<un>(?:[!au]|P(?=[in!sPpUSf]))*+(?&prim)(?&post)*+u?+)
(?<prim>(?:P|i)A(?:C|(?&expr))|p(?&mods)(?&name)(?&targs)?(?:\.i(?&targs)?)*(?:PC?|B+C?)|SPC|[insPU]|(?&type)(?=\.))
(?<post>P|B|\.(?&targs)?(?:i|p P?C?|p|U)|(?&targs)\.i)
(?<seq>(?&expr)(?:,(?&expr))*+)
(?<args>(?&seq)?)
(?<list>(?:(?:C|(?&expr))(?:,|$))*+)
(?<vars>(?&mods)(?&type)iB*(?:=(?:C|(?&expr)))?(?:,iB*(?:=(?:C|(?&expr)))?)*)
(?<st>;|C|IP(?&st)(?:E(?&st))?|FP(?&st)|WP(?&st)|D(?&st)WP;|SPC|T(?:P?C)(?:HPC)*(?:YC)?|wPC|[Rt](?&expr)?(?::(?&expr))?;|J i?;|(?&mods)(?&kind)|(?&vars);|i:(?&st)|(?&expr);)
(?<block>(?&st)*+)
(?<switch>(?:(?:K(?:(?&type)i|(?&expr))(?:,(?&expr))*|d)(?::(?&block)|A(?:C|t(?&expr);|(?&expr);)))*+)
(?<param>(?&mods)(?&type)(?:i\.)?[iU]B*)
(?<params>(?:(?&param)(?:,(?&param))*)?|i(?:,i)*)
(?<loop>(?:(?&vars)|(?&seq))?;(?&expr)?;(?&seq)?|(?&mods)(?&type)i:(?&expr))
(?<res>(?:(?&vars)|(?&expr))(?:;(?:(?&vars)|(?&expr)))*;?)
(?<catch>(?&mods)(?&type)(?:\|(?&type))*i)
(?<annos>(?:(?:i=)?(?:C|(?&anno)|(?&expr))(?:,|$))*+)
(?<kind>@?c i(?&targs)?P?(?:x(?&type)(?:,(?&type))*)?(?:h(?&type)(?:,(?&type))*)*C)
(?<member>;|w?C|(?&mods)(?&kind)|(?&mods)(?&targs)?(?:(?&type))?iPB*(?:h(?&type)(?:,(?&type))*)?(?:C|;|d(?:C|(?&expr));)|(?&mods)iC|(?&vars);)
(?<class>(?&member)*+)
(?<enum>(?:(?&anno)*iP?C?(?:,|(?=;)|$))*+(?:;(?&member)*+)?)
(?<file>(?:(?&anno)*k(?&name);)?(?:m w?(?&name)(?:\.\*)?;|;)*(?:(?&mods)(?&kind)|;)*+)
"""


def _go_values(tag: str, composite: str) -> str:
    return rf"""
(?<expr{tag}>(?&un{tag})(?:[oaLG*&|](?&un{tag}))*+)
(?<un{tag}>(?:[!a*&]|oN?)*+(?&prim{tag})(?&post{tag})*+)
(?<prim{tag}>fP(?&result)?C|{composite}[insrP]|B*(?&type)(?=P)|(?&type)(?=[,P]|$))
(?<post{tag}>P|B|\.(?:i|P){"|C" if not tag else ""})
(?<seq{tag}>(?&expr{tag})(?:,(?&expr{tag}))*+)
(?<simple{tag}>(?&seq{tag})(?:u|==?l?(?&seq{tag})|=l(?&expr{tag})|=(?&seq{tag}))?|l(?&expr{tag}))
"""


_GO = (
    r"""
(?<type>(?:[*~]|B|oN|N o?)*+(?:i(?:\.i)?B?+|tC|MB(?&type)|fP(?&result)?|P)(?:[|](?&type))*)
(?<result>(?&type))
"""
    + _go_values("", r"(?:B+(?&type)|MB(?&type)|tC|i(?:\.i)?B?)C|MB(?&type)(?=P|$|,)|")
    + _go_values("0", r"(?:B+(?&type)|MB(?&type))C|")
    + r"""
(?<end>;|$)
(?<head>(?:(?&simple0)?;)?(?&simple0)?)
(?<if>I(?&head)C(?:E(?:(?&if)|C))?)
(?<st>;|C(?&end)|(?&if)(?&end)|F(?:(?&simple0)?;(?&expr0)?;(?&simple0)?|(?&simple0)?)C(?&end)|S(?&head)C(?&end)|g(?&expr)(?&end)|R(?&seq)?(?&end)|J i?(?&end)|(?&decl)(?&end)|i:;?(?&st)?|(?&simple)(?&end))
(?<decl>v(?:P|(?&spec))|z(?:P|i(?:B)?=?(?&type)))
(?<spec>i(?:,i)*(?&type)?(?:=(?&seq))?)
(?<specs>(?:(?&spec)(?&end)|;)*+)
(?<types>(?:iB?=?(?&type)(?&end)|;)*+)
(?<block>(?&st)*+)
(?<switch>;?(?:(?:K(?:(?&simple)|(?&type)(?:,(?&type))*)|d):(?&block))*+)
(?<args>(?:(?&arg)(?:,(?&arg))*+,?)?e?,?|z)
(?<arg>(?:(?&expr)|(?&type))e?)
(?<list>(?:(?:(?:C|(?&expr)):)?(?:C|(?&expr))(?:,|;?$))*+)
(?<params>(?:(?:i(?:,i)*e?(?&type)|e?(?&type))(?:,|$))*+)
(?<index>(?:(?&expr)?(?::(?&expr)?)*|(?&type)(?:,(?&type))*|e|(?:i(?:,i)*(?&type),?)+)?)
(?<struct>(?:(?:i(?:,i)*(?&type)|\*?i(?:\.i)?B?)s?(?&end)|iP(?&result)?(?&end)|(?&type)(?&end)|;)*+)
(?<imports>(?:(?:i|\.)?s(?&end)|;)*+)
(?<file>;*k i;(?:m(?:P|(?:i|\.)?s);|;)*+(?:fP?iB?P(?&result)?C?(?&end)|(?&decl)(?&end)|;)*+)
"""
)
_PHP = r"""
(?<type>\??(?&ty)(?:[|&](?&ty))*+)
(?<ty>[iw]|P)
(?<seq>(?&expr)(?:,(?&expr))*+)
(?<expr>(?&un)(?:o(?&un)|[a=L*&|.G]{1,2}&?(?&un)|\?(?&expr)?:(?&expr))*+)
(?<un>(?:[p!au@&]|P(?=[iVsPpn!@]))*+(?&prim)(?&post)*+u?+)
(?<prim>w?f&?P(?:mP)?(?::(?&type))?C|w?l&?P(?::(?&type))?A(?&expr)|SPC|cP?(?:x i)?(?:h i(?:,i)*)?C|t(?&expr)|R(?&expr)?|(?:\#B)+(?&prim)|[Vinswm]|[PB])
(?<post>P|B|C|\:(?:i|V|C|c)|i(?!.))
(?<end>;|$)
(?<st>;|C|IP(?&st)(?:E(?:IP)?(?&st))*|FP(?&st)|WP(?&st)|D(?&st)WP(?&end)|SP(?:C|;)|TC(?:HPC)*(?:YC)?|R(?&seq)?(?&end)|v(?:[iV](?:=(?&expr))?)(?:,[iV](?:=(?&expr))?)*(?&end)|wV(?:=(?&expr))?(?:,V(?:=(?&expr))?)*(?&end)|(?:\#B)*f&?iP(?::(?&type))?C|(?:\#B)*w*(?&kind)|k i?(?:;|C)|m[fv]?i\\?(?:C|j i)?(?:,i(?:j i)?)*(?&end)|i:|(?&seq)(?&end))
(?<kind>c i(?::(?&type))?(?:x i(?:,i)*)?(?:h i(?:,i)*)?C)
(?<block>(?&st)*+)
(?<switch>(?:(?:K(?&expr)|d)[:;](?&block))*+)
(?<match>(?:(?:(?&seq),?|d)A(?&expr)(?:,|$))*+)
(?<args>(?:(?:[id]:)?e?(?&expr)(?:,(?:[id]:)?e?(?&expr))*,?)?|e)
(?<list>(?:(?:(?&expr)A)?(?:e|&)?(?&expr)?(?:,|$))*+)
(?<param>(?:\#B)*w*(?&type)?&?e?V(?:=(?&expr))?)
(?<params>(?:(?&param)(?:,(?&param))*,?)?|(?:&?V(?:,&?V)*,?)?)
(?<loop>(?&seq)?;(?&seq)?;(?&seq)?|(?&expr)j(?:(?&expr)A)?&?(?&expr)|i=(?&expr)(?:,i=(?&expr))*)
(?<catch>(?&type)V?)
(?<class>(?:;|(?:\#B)*(?:w*f&?iP(?::(?&type))?(?:C|;)|w*v(?:i)?(?:i=(?&expr))(?:,i=(?&expr))*;|w+(?&type)?V(?:=(?&expr))?(?:,V(?:=(?&expr))?)*;|m i(?:,i)*(?:C|;)|K i(?:=(?&expr))?;))*+)
(?<traits>(?:i(?::i)?j(?:w?i?|i(?:,i)*);)*)
(?<names>(?:i(?:j i)?(?:,|$))*+)
"""
#: What may stand in each pair of brackets, and in a file.
ENTRIES = {
    "JavaScript": {"P": "args params loop target", "B": "list", "C": "object block class switch names", "X": "seq", "": "block"},
    "TypeScript": {"P": "args params loop target type", "B": "list type index", "C": "object block class switch names body enum", "X": "seq type", "": "block"},
    "Java": {"P": "args params loop res catch annos type", "B": "args", "C": "block class list switch enum annos", "": "file"},
    "Go": {"P": "args params specs types imports head", "B": "index args", "C": "block list switch struct", "": "file"},
    "PHP": {"P": "args params loop catch list type", "B": "list args", "C": "block class switch match traits names seq", "": "block"},
    "Python": {"P": "group args params names withs pats", "B": "list index", "C": "dict list", "": "line"},
}
_RULES = {"JavaScript": _PLAIN_RULES, "TypeScript": _SCRIPT + r"(?<index>(?&ident):(?&type)|(?&ident)o(?&type)|p(?&ty))", "Java": _JAVA, "Go": _GO, "PHP": _PHP, "Python": _PYTHON}


@functools.cache
def _entry(language: str, pair: str) -> regex.Pattern:
    choice = "|".join(f"(?:(?&{x}))$" for x in ENTRIES[language][pair].split())
    return regex.compile(rf"(?x)(?(DEFINE){_RULES[language]})(?:{choice})")


#: Symbols that begin what may be read in two ways; reading back and forth costs up to two to the power of their number.
_TWO_WAYS = regex.compile(r"[L?]|[Pi]A")
_FEW = 8


def _few_readings(word: str) -> bool:
    """Whether backtracking ends soon. If not, a slower way with the same answer, in time polynomial in the length, is taken."""
    return len(_TWO_WAYS.findall(word)) <= _FEW


@functools.lru_cache(maxsize=200_000)
def allowed(language: str, pair: str, word: str) -> bool:
    """Whether ``word`` may stand in ``pair``."""
    if _few_readings(word):
        return _entry(language, pair).match(word) is not None
    return matches(_RULES[language], tuple(ENTRIES[language][pair].split()), word)


#: Symbols after which, and before which, a line end may end a statement.
_ENDING, _BEGINNING = frozenset("insrPBCXuygwzjJRVdUG!"), frozenset("insruCvfcmqpyRtIFWDSTJ!@wzgKd#jh")


def _operator(language: str, text: str) -> str:
    if language == "Python":
        fixed = {"+": "a", "-": "a", "**": "S", ":=": "w", "->": ">", "...": "n"}
        return fixed.get(text) or (text if text in "*/@~:;,.=" else "g" if text.endswith("=") and text not in ("==", "!=", "<=", ">=") else "o")
    if language == "PHP" and text in ("->", "?->", "::"):
        return ":"
    if language == "PHP" and text == ".":
        return "."
    if language == "Java" and text in ("<>", "->", "::"):
        return {"<>": "L", "->": "A", "::": "."}[text]
    if language == "Go" and text == "<-":
        return "o"
    return _OPERATORS.get(text) or (text if text in _KEPT else "=" if text.endswith("=") and text not in ("==", "===", "!=", "!==", "<=", ">=") else "o")


#: Codes of words and operators that are fixed in each language; operators are added as they are met.
_CODES: dict[str, dict[str, str]] = {language: {word: symbol + word for word, symbol in words.items()} for language, words in WORDS.items()}
for _soft in ("match", "case", "type"):
    _CODES["Python"][_soft] = "i" + _soft


def code_of(language: str, token: Token, margin: str = "") -> str:
    """The code of a token that is no closing bracket."""
    kind, text, _, fresh = token
    codes = _CODES[language]
    if kind == "w":
        code = codes.get(text.lower() if language == "PHP" else text)
        if code is None:
            code = "V" if text[0] == "$" and language == "PHP" else "i"
    elif kind == "o":
        code = codes.get(text)
        if code is None:
            code = codes[text] = _operator(language, text) + text
    elif kind == "(":
        code = _OPEN[text] + text
    elif kind == "s" and language == "Python" and text[-3:] not in ("'''", '"""') and "f" in text[:2].lower().split(text[-1])[0]:
        code = "s" if _braces_match(text) else "\0"
    else:
        code = kind if kind in "nsr" else "\0"
    if not fresh:
        return code
    return f"\n{margin}\n{code}" if language == "Python" else "\n" + code


def _plain_code(code: str) -> str:
    return code.rpartition("\n")[2]


def word_of(language: str, pair: str, codes: tuple[str, ...]) -> str:
    """The word of one content of brackets or, with an empty ``pair``, of a file."""
    script, go = language in SCRIPTS, language == "Go"
    if language == "Python":
        return "".join(_plain_code(c)[0] for c in codes)
    word: list[str] = []
    head, size = False, len(codes)
    for place, code in enumerate(codes):
        fresh = code[0] == "\n"
        if fresh:
            code = code[1:]
        symbol, text = code[:1], code[1:]
        opens = symbol in "PBCX" and text != ""
        before = word[-1] if word else ""
        if text == "<>":
            symbol = "LG" if language == "Java" else symbol
        elif text and text[0].isalpha():
            following = _plain_code(codes[place + 1]) if place + 1 < size else ""
            if language == "PHP":
                if before == ":" and len(word) > 1 and _plain_code(codes[place - 1]) != "::":
                    symbol = "i"
            elif language == "TypeScript" and text == "void" and before in (":", "A", "|"):
                symbol = "i"
            elif before == "." and not (language == "Java" and text in ("new", "super")):
                symbol = "i"
            if text == "record" and language == "Java" and not (following and (following[0] == "i" or following[1:2].isalpha())):
                symbol = "i"
            if script and symbol in "zjwgyo" and text not in ("in", "instanceof"):
                # words with a meaning in some places only
                closed = not following  # by a bracket, or by the end of the file
                operator = bool(following[1:]) and not following[1].isalpha() and following[0] not in "PBCX"
                bracket = following[:2] == "P("
                if closed or (operator and following[1:] not in ("#", "@", "*", "...")) or (bracket and symbol not in "oy" and text != "as"):
                    symbol = "i"
                elif symbol == "o" and text == "of" and pair != "P":
                    symbol = "i"
                elif symbol == "z" and pair == "P":
                    symbol = "i"
        if fresh and word and pair in ("", "C"):
            if script and before in _ENDING and symbol in _BEGINNING and not (symbol == "C" and before in "PiGBC") and not (before == "P" and head) and symbol not in ("o", "j", "h"):
                word.append(";")
            if go and before in "insrPBCuJRG":
                word.append(";")
        if go and fresh and pair == "P" and word and before in "insPBC" and symbol:
            word.append(";")
        if script and opens:
            before = word[-1] if word else ""
            head = symbol == "P" and before in ("I", "F", "W", "p")
        if symbol:
            word.append(symbol)
    return "".join(word)


_REPEATS = regex.compile(r"((?:[^,;]{1,16},))\1{2,}")
_STATEMENTS = regex.compile(r"(?<=;)|(?<=C)(?=[IFWSTRvfcwJt])")
#: What is a sequence of any number of parts: valid parts in a row are valid.
_SEQUENCES = {"JavaScript": ["block"], "TypeScript": ["block"], "Java": ["block", "class"], "Go": ["block"], "PHP": ["block", "class"]}
#: Stands behind a part that is not the last one, where no statement may end as at the end of all.
_MORE = "\0"


@functools.cache
def _sequence(language: str, name: str) -> regex.Pattern:
    return regex.compile(rf"(?x)(?(DEFINE){_RULES[language]})(?&{name})(?:{_MORE})?$")


@functools.lru_cache(maxsize=100_000)
def _part(language: str, name: str, word: str) -> bool:
    if _few_readings(word):
        return _sequence(language, name).match(word) is not None
    return matches(_RULES[language], (name,), word, len(word.removesuffix(_MORE)))


def _in_parts(language: str, pair: str, word: str) -> bool:
    """Whether the word can be cut into statements or members that are each valid and closed before the next; if not, it may still be allowed as a whole."""
    parts = _STATEMENTS.split(word)
    if len(parts) < 3:
        return False
    parts = [p + _MORE for p in parts[:-1]] + parts[-1:]
    allowed_here = ENTRIES[language][pair].split()
    return any(all(_part(language, name, p) for p in parts) for name in _SEQUENCES[language] if name in allowed_here)


@functools.lru_cache(maxsize=200_000)
def content_allowed(language: str, pair: str, codes: tuple[str, ...]) -> bool:
    """Whether the content with these codes may stand in ``pair``. Of equal entries in a row, two count."""
    if language == "Python" and pair == "":
        return python_file_allowed(codes)
    word = word_of(language, pair, codes)
    if language != "Python" and (pair == "C" or (pair == "" and language not in ("Java", "Go"))) and _in_parts(language, pair, word):
        return True
    return allowed(language, pair, _REPEATS.sub(r"\1\1", word))


@functools.cache
def _python_rule(name: str) -> regex.Pattern:
    return regex.compile(rf"(?x)(?(DEFINE){_PYTHON})(?&{name})$")


@functools.lru_cache(maxsize=200_000)
def python_pair(pair: str, codes: tuple[str, ...]) -> str:
    """The symbol of a Python pair with this content: ``P``, ``u`` arguments only, ``r`` neither; ``B``, ``b`` list only, ``x`` index only; ``C``."""
    word = word_of("Python", pair, codes)
    if not (word or pair == "B"):
        return pair
    word = _REPEATS.sub(r"\1\1", word)
    if pair == "P":
        return "P" if _python_rule("group").match(word) else "u" if _python_rule("args").match(word) else "r"
    if pair == "B":
        listed, index = (bool(_python_rule(rule).match(word)) for rule in ("list", "index"))
        return "B" if listed and index else "b" if listed else "x"
    return pair


def _braces_match(text: str) -> bool:
    """Whether the braces in a formatted string do."""
    depth = at = 0
    while at < len(text):
        if not depth and text[at : at + 2] in ("{{", "}}"):
            at += 1
        elif text[at] in "{}":
            depth += 1 if text[at] == "{" else -1
            if depth < 0:
                return False
        at += 1
    return not depth


_CLAUSES = {"E": "IQWfTX", "Q": "IQ", "X": "TX", "Y": "TXE"}  #: after which statement of the same margin each may stand


def python_file_allowed(codes: tuple[str, ...]) -> bool:
    """Whether logical lines and their margins make a Python file.

    Each line is a word of its own; a header without a body opens a block, a margin that becomes smaller closes
    blocks. Returns, breaks and clauses must stand where they may.
    """
    lines: list[tuple[str, str]] = []
    for code in codes:
        _, margin, plain = code.split("\n") if code[0] == "\n" else ("", None, code)
        if margin is not None or not lines:
            lines.append((margin or "", plain[0]))
            if plain in ("imatch", "icase", "itype"):
                lines[-1] = (margin or "", plain[1] + "\0")
        else:
            lines[-1] = (lines[-1][0], lines[-1][1] + plain[0])
    blocks: list[list] = [[0, "", ""]]  # margin, kind of what opened it, kind of the last statement in it
    opened = ""
    for margin, word in lines:
        width = len(margin.expandtabs(8))
        if word[1:2] == "\0":  # match, case or type: a word of the language or a name
            soft, word = {"m": "M", "c": "K", "t": "z"}[word[0]] + word[2:], "i" + word[2:]
            if allowed("Python", "", _REPEATS.sub(r"\1\1", soft)) and not (soft[0] in "MK" and not soft.endswith(":") and allowed("Python", "", word)):
                word = soft
        if not allowed("Python", "", _REPEATS.sub(r"\1\1", word)):
            return False
        if opened and width <= blocks[-1][0]:
            return False
        if opened:
            blocks.append([width, opened, ""])
        while width < blocks[-1][0]:
            if blocks.pop()[2] in ("T", "@"):
                return False
        if width != blocks[-1][0]:
            return False
        kind = word[1] if word[0] == "y" and len(word) > 1 else word[0]
        last = blocks[-1][2]
        if kind in _CLAUSES:
            if not last or last not in _CLAUSES[kind] or (kind == "E" and last == "T"):
                return False
        elif last == "T" or (last == "@" and kind not in "dc@"):
            return False
        if kind == "K" and blocks[-1][1] != "M" or blocks[-1][1] == "M" and kind != "K":
            return False
        blocks[-1][2] = kind
        around = [b[1] for b in blocks[1:]]
        scopes = [k for k in [*around, "a" if word.startswith("yd") else kind if kind == "d" else ""] if k and k in "dac"]
        if any(part[:1] == "R" for part in regex.split("[:;]", word)) and (not scopes or scopes[-1] == "c"):
            return False
        if "J" in word:
            inner = next((k for k in reversed(around) if k in "dacWf"), "")
            if inner not in ("W", "f") and kind not in "Wf":
                return False
        if ("N" in word and (not scopes or scopes[-1] == "c")) or ("v" in word and "l" not in word and (not scopes or scopes[-1] != "a")):
            return False
        opened = ""
        if word.endswith(":"):
            opened = "a" if word.startswith("yd") else kind
    return not opened and all(b[2] not in ("T", "@") for b in blocks)
