"""License scans by ordered signature rules.

A text is lower-cased and reduced to words joined by single blanks. Rules run in order of
priority, each behind a keyword that the text must hold. A detection that lies inside
the interval of an accepted one is suppressed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, map_texts

#: Words are a-z, 0-9 and everything beyond ASCII; all else becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))

BASE = [(rb"under the mit license", "mit"), (rb"apache license version 2", "apache-2"), (rb"cc by nc", "cc-by-nc")]

_V = r"(?: (?:version|ver|versions|v))? v?"
_L = r"licen[cs]e"

# Label, gate keyword, and the license's name as a pattern over folded words.
NAMES = [
    ("mit", "mit", rf"(?:the )?mit {_L}"),
    ("mit", "expat", rf"(?:the )?expat {_L}"),
    ("mit-0", "mit", rf"mit no attribution(?: {_L})?|mit 0"),
    ("apache-2", "apache", rf"(?:the )?apache (?:software )?{_L}{_V}2(?: 0)?|apache 2(?: 0)?(?: {_L})?"),
    ("apache-1.1", "apache", rf"(?:the )?apache (?:software )?{_L}{_V}1 1|apache 1 1"),
    ("apache-1.0", "apache", rf"(?:the )?apache (?:software )?{_L}{_V}1 0|apache 1 0"),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd) bsd {_L}|bsd 2 clause(?: {_L})?|2 clause bsd(?: {_L})?|two clause bsd(?: {_L})?"),
    ("bsd-3-clause", "bsd", rf"(?:new|modified|revised) bsd {_L}|bsd 3 clause(?: {_L})?|3 clause bsd(?: {_L})?|three clause bsd(?: {_L})?"),
    ("bsd-4-clause", "bsd", rf"(?:original|old) bsd {_L}|bsd 4 clause(?: {_L})?|4 clause bsd(?: {_L})?"),
    ("0bsd", "bsd", rf"0bsd|zero clause bsd(?: {_L})?|bsd zero clause(?: {_L})?"),
    ("agpl-3", "affero", rf"(?:gnu )?affero general public {_L}(?:{_V}3(?: 0)?)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: ?v(?:ersion)?)? ?3(?: 0)?|agplv3"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public {_L}{_V}2 1"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: ?v(?:ersion)?)? ?2 1|lgplv2 1"),
    ("lgpl-3", "lesser", rf"(?:gnu )?lesser general public {_L}{_V}3(?: 0)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: ?v(?:ersion)?)? ?3(?: 0)?|lgplv3"),
    ("lgpl-2", "library", rf"(?:gnu )?library general public {_L}(?:{_V}2(?: 0)?)?"),
    ("lgpl", "lesser", rf"(?:gnu )?lesser general public {_L}"),
    ("gpl-3", "gnu", rf"gnu general public {_L}{_V}3(?: 0)?|gnu gpl{_V}3(?: 0)?"),
    ("gpl-3", "gpl", r"gpl ?v ?3(?: 0)?|gpl(?: version)? 3(?: 0)?|gplv3"),
    ("gpl-2", "gnu", rf"gnu general public {_L}{_V}2(?: 0)?|gnu gpl{_V}2(?: 0)?"),
    ("gpl-2", "gpl", r"gpl ?v ?2(?: 0)?|gpl(?: version)? 2(?: 0)?|gplv2"),
    ("gpl-1", "gnu", rf"gnu general public {_L}{_V}1(?: 0)?"),
    ("gpl", "gnu", rf"gnu general public {_L}|gnu gpl"),
    ("gfdl", "documentation", rf"(?:gnu )?free documentation {_L}(?:{_V}1 [123])?"),
    ("mpl-2", "mozilla", rf"mozilla public {_L}{_V}2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public {_L}{_V}1 1"),
    ("mpl-1.0", "mozilla", rf"mozilla public {_L}{_V}1 0"),
    ("mpl-2", "mpl", r"mpl(?: v(?:ersion)?)? ?2(?: 0)?|mplv2"),
    ("epl-2", "eclipse", rf"eclipse public {_L}{_V}2(?: 0)?"),
    ("epl-1", "eclipse", rf"eclipse public {_L}{_V}1(?: 0)?"),
    ("edl-1", "eclipse", rf"eclipse distribution {_L}(?:{_V}1(?: 0)?)?"),
    ("cddl-1.1", "distribution", rf"common development and distribution {_L}{_V}1 1"),
    ("cddl-1.1", "cddl", r"cddl(?: ?v(?:ersion)?)? ?1 1"),
    ("cddl-1.0", "distribution", rf"common development and distribution {_L}(?:{_V}1 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: ?v(?:ersion)?)? ?1 0"),
    ("cpl-1.0", "common", rf"common public {_L}(?:{_V}1 0)?"),
    ("cpal-1.0", "attribution", rf"common public attribution {_L}(?:{_V}1 0)?"),
    ("isc", "isc", rf"(?:the )?isc {_L}"),
    ("zlib", "zlib", rf"(?:the )?zlib(?: libpng)? {_L}"),
    ("libpng", "libpng", rf"libpng {_L}(?:{_V}2(?: 0)?)?"),
    ("bsl-1.0", "boost", rf"boost software {_L}(?:{_V}1(?: 0)?)?"),
    ("busl-1.1", "business", rf"business source {_L}(?:{_V}1 1)?"),
    ("sspl-1", "server", rf"server side public {_L}(?:{_V}1(?: 0)?)?"),
    ("elastic-2", "elastic", rf"elastic {_L}(?:{_V}2(?: 0)?)?"),
    ("artistic-2", "artistic", rf"artistic {_L}{_V}2(?: 0)?"),
    ("artistic-1", "artistic", rf"artistic {_L}(?:{_V}1(?: 0)?)?"),
    ("python-2", "python", rf"python software foundation {_L}(?:{_V}2(?: 0)?)?"),
    ("python-2", "psf", rf"psf {_L}"),
    ("php-3.01", "php", rf"php {_L}(?:{_V}3 01)?"),
    ("ruby", "ruby", rf"ruby {_L}"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?"),
    ("wtfpl", "what the", rf"do what the f\w* you want to public {_L}"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("upl-1.0", "universal", rf"universal permissive {_L}(?:{_V}1(?: 0)?)?"),
    ("ms-pl", "microsoft", rf"microsoft public {_L}"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {_L}"),
    ("ms-rl", "ms rl", r"ms rl"),
    ("eupl-1.2", "union", rf"european union public {_L}{_V}1 2"),
    ("eupl-1.1", "union", rf"european union public {_L}(?:{_V}1 1)?"),
    ("eupl-1.1", "eupl", r"eupl(?: version)? ?v?1 1"),
    ("eupl-1.2", "eupl", r"eupl(?: v?1 2)?"),
    ("osl-3", "open software", rf"open software {_L}(?:{_V}3(?: 0)?)?"),
    ("afl-3", "academic", rf"academic free {_L}(?:{_V}3(?: 0)?)?"),
    ("ecl-2", "educational", rf"educational community {_L}(?:{_V}2(?: 0)?)?"),
    ("ofl-1.1", "font", rf"(?:sil )?open font {_L}(?:{_V}1 1)?"),
    ("odbl-1.0", "database", rf"open (?:data commons open )?database {_L}(?:{_V}1 0)?"),
    ("odbl-1.0", "odbl", r"odbl(?: v?1 0)?"),
    ("odc-by-1.0", "attribution", rf"open data commons attribution {_L}(?:{_V}1 0)?"),
    ("pddl-1.0", "public domain", rf"(?:open data commons )?public domain dedication and {_L}"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa (?:open source )?{_L}"),
    ("postgresql", "postgresql", rf"postgresql {_L}"),
    ("openssl", "openssl", rf"openssl {_L}"),
    ("vim", "vim", rf"vim {_L}"),
    ("w3c", "w3c", rf"w3c software(?: notice and)? {_L}"),
    ("x11", "x11", rf"x11 {_L}"),
    ("curl", "curl", rf"curl {_L}"),
    ("unicode", "unicode", rf"unicode(?: inc)? {_L}(?: agreement)?"),
    ("intel", "intel", rf"intel open source {_L}"),
    ("nasa-1.3", "nasa", rf"nasa open source agreement(?: 1 3)?"),
    ("qpl-1.0", "q public", rf"q public {_L}(?:{_V}1(?: 0)?)?"),
    ("sleepycat", "sleepycat", rf"sleepycat {_L}"),
    ("zpl-2.1", "zope", rf"zope public {_L}(?:{_V}2 1)?"),
    ("mulan-psl-2", "mulan", rf"mulan (?:permissive software|psl) {_L}(?: ?v?2)?|mulan psl ?v?2"),
    ("cecill-2.1", "cecill", rf"cecill(?: {_L})?(?:{_V}2 1)?"),
    ("openrail-m", "rail", rf"(?:bigscience |creativeml )?open ?rail(?: m)?(?: {_L})?"),
    ("llama", "llama", rf"llama \d(?: \d)? community {_L}"),
    ("beerware", "beer", rf"(?:the )?beer ?ware {_L}"),
    ("jsr", "java", rf"java research {_L}"),
    ("python-2", "python", rf"(?:the )?python {_L}(?:{_V}2(?: 0)?)?"),
    ("cnri-python", "cnri", rf"cnri (?:open source )?python {_L}(?: agreement)?|cnri open source {_L} agreement"),
    ("json", "json", rf"(?:the )?json {_L}"),
    ("ijg", "jpeg", rf"(?:the )?independent jpeg group(?: s)? {_L}"),
    ("tcl", "tcl", rf"tcl tk {_L}|tcl {_L}"),
    ("icu", "icu", rf"icu {_L}"),
    ("ftl", "freetype", rf"freetype(?: project)? {_L}"),
    ("bzip2", "bzip2", rf"bzip2(?: libbzip2)? {_L}"),
    ("lppl-1.3", "latex", rf"latex project public {_L}{_V}1 3[abc]?"),
    ("lppl", "latex", rf"latex project public {_L}"),
    ("lppl", "lppl", r"lppl(?: v?1 [0123][abc]?)?"),
    ("opl-1.0", "publication", rf"open publication {_L}(?:{_V}1(?: 0)?)?"),
    ("opl-content", "open content", rf"open content {_L}"),
    ("fal-1.3", "free art", rf"free art {_L}(?:{_V}1 3)?"),
    ("fal-1.3", "licence art libre", r"licence art libre"),
    ("gust-font", "gust", rf"gust font {_L}"),
    ("bitstream-vera", "vera", rf"bitstream vera(?: fonts?)? {_L}"),
    ("ubuntu-font", "ubuntu", rf"ubuntu font {_L}(?:{_V}1 0)?"),
    ("apsl-2", "apple", rf"apple public source {_L}(?:{_V}[12](?: [0-2])?)?"),
    ("hippocratic", "hippocratic", rf"hippocratic {_L}(?:{_V}\d(?: \d)?)?"),
    ("commons-clause", "commons clause", rf"commons clause(?: {_L})?(?: condition)?(?:{_V}1 0)?"),
    ("ogl-uk-3", "government", rf"open government {_L}(?:{_V}[123](?: 0)?)?"),
    ("etalab-2", "etalab", rf"etalab(?: open)? {_L}(?: 2 0)?"),
    ("etalab-2", "licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: [12] 0)?(?: etalab)?"),
    ("dl-de-by-2", "data licence germany", r"data licence germany attribution(?: version)?(?: 2 0)?"),
    ("dl-de-zero-2", "data licence germany", r"data licence germany zero(?: version)?(?: 2 0)?"),
    ("cdla-permissive", "community data", rf"community data {_L} agreement permissive(?:{_V}[12] 0)?"),
    ("cdla-sharing", "community data", rf"community data {_L} agreement sharing(?:{_V}1 0)?"),
    ("confluent", "confluent", rf"confluent community {_L}(?: agreement)?(?:{_V}1 0)?"),
    ("rsal-2", "redis", rf"redis source available {_L}(?: agreement)?(?:{_V}[12](?: 0)?)?"),
    ("timescale", "timescale", rf"timescale {_L}(?: agreement)?"),
    ("fsl-1.1", "functional source", rf"functional source {_L}(?:{_V}1 [01])?"),
    ("prosperity", "prosperity", rf"prosperity public {_L}(?:{_V}\d(?: \d)*)?"),
    ("parity", "parity", rf"parity public {_L}(?:{_V}\d(?: \d)*)?"),
    ("polyform-nc", "polyform", rf"polyform non ?commercial {_L}(?:{_V}1 0(?: 0)?)?"),
    ("polyform-sb", "polyform", rf"polyform small business {_L}(?:{_V}1 0(?: 0)?)?"),
    ("polyform-shield", "polyform", rf"polyform (?:shield|perimeter|strict|internal use) {_L}(?:{_V}1 0(?: 0)?)?"),
    ("blueoak-1.0", "blue oak", rf"blue oak model {_L}(?:{_V}1 0(?: 0)?)?"),
    ("anti-996", "996", rf"anti 996 {_L}(?:{_V}1 0)?"),
    ("cal-1.0", "cryptographic", rf"cryptographic autonomy {_L}(?:{_V}1 0)?"),
    ("cern-ohl", "cern", rf"cern open hardware {_L}(?:{_V}[12](?: [0-2])?)?|cern ohl(?: [spw])?(?: 2 0)?"),
    ("tapr-ohl", "tapr", rf"tapr open hardware {_L}(?:{_V}1 0)?"),
    ("solderpad", "solderpad", rf"solderpad(?: hardware)? {_L}(?:{_V}[02] 51?)?"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("ntp", "ntp", rf"ntp {_L}"),
    ("miros", "miros", rf"miros {_L}"),
    ("multics", "multics", rf"multics {_L}"),
    ("naumen", "naumen", rf"naumen public {_L}"),
    ("ngpl", "nethack", rf"nethack general public {_L}"),
    ("nokia", "nokia", rf"nokia open source {_L}"),
    ("oclc-2", "oclc", rf"oclc research public {_L}(?:{_V}2(?: 0)?)?"),
    ("ogtsl", "open group", rf"open group test suite {_L}"),
    ("rpl-1.5", "reciprocal public", rf"reciprocal public {_L}(?:{_V}1 [15])?"),
    ("rpsl-1", "realnetworks", rf"realnetworks public source {_L}(?:{_V}1 0)?"),
    ("ricoh-1", "ricoh", rf"ricoh source code public {_L}"),
    ("simpl-2", "simple public", rf"simple public {_L}(?:{_V}2 0)?"),
    ("sissl", "sun industry", rf"sun industry standards source {_L}(?:{_V}1 [12])?"),
    ("spl-1", "sun public", rf"sun public {_L}(?:{_V}1 0)?"),
    ("vsl-1", "vovida", rf"vovida software {_L}(?:{_V}1 0)?"),
    ("watcom-1", "watcom", rf"(?:sybase open )?watcom public {_L}(?:{_V}1 0)?"),
    ("xnet", "xnet", rf"xnet {_L}"),
    ("xnet", "x net", rf"x net {_L}"),
    ("efl-2", "eiffel", rf"eiffel forum {_L}(?:{_V}[12](?: 0)?)?"),
    ("entessa", "entessa", rf"entessa public {_L}"),
    ("fair", "fair", rf"fair {_L}"),
    ("frameworx-1", "frameworx", rf"frameworx(?: open)? {_L}(?:{_V}1 0)?"),
    ("ipl-1", "ibm", rf"ibm public {_L}(?:{_V}1 0)?"),
    ("lucent", "lucent", rf"lucent public {_L}(?:{_V}1 0[2]?)?"),
    ("catosl", "computer associates", rf"computer associates trusted open source {_L}(?:{_V}1 1)?"),
    ("motosoto", "motosoto", rf"motosoto(?: open source)? {_L}"),
    ("afmparse", "adobe", rf"adobe (?:font metrics|glyph list|systems incorporated source code) {_L}(?: agreement)?"),
    ("oldap-2.8", "openldap", rf"openldap public {_L}(?:{_V}2 \d)?"),
    ("d-fsl-1", "freie software", r"deutsche freie software lizenz"),
    ("liliq", "qu bec", rf"licence libre du qu bec"),
    ("apple-mit", "apple", rf"apple mit {_L}"),
    ("boehm-gc", "boehm", rf"boehm demers weiser (?:gc |garbage collector )?{_L}"),
    ("zend-2", "zend", rf"zend {_L}(?:{_V}2(?: 0)?)?"),
    ("gsap", "greensock", rf"(?:standard )?greensock(?: standard)? {_L}"),
    ("gemma", "gemma", rf"gemma terms of use|gemma {_L}"),
    ("qwen", "qwen", rf"qwen(?: research)? {_L}(?: agreement)?"),
    ("qwen", "qianwen", rf"(?:tongyi )?qianwen {_L}(?: agreement)?"),
    ("deepseek", "deepseek", rf"deepseek(?: model)? {_L}(?: agreement)?"),
    ("falcon", "falcon", rf"falcon (?:\d+b )?(?:tii )?(?:llm )?{_L}"),
    ("stability", "stability", rf"stability ai (?:community|non ?commercial research) {_L}(?: agreement)?"),
    ("nvidia-open-model", "nvidia", rf"nvidia open model {_L}(?: agreement)?"),
    ("nvidia-eula", "nvidia", rf"nvidia (?:software|source code|cuda|end user) {_L}(?: agreement)?"),
    ("oracle-bcl", "oracle", rf"oracle binary code {_L}(?: agreement)?"),
    ("otn", "oracle technology", rf"oracle technology network {_L}(?: agreement)?"),
    ("gpl-classpath", "classpath", r"gnu classpath exception|classpath exception(?: 2 0)?|gpl(?: v?2)? with (?:the )?classpath exception"),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception(?: version)?(?: 3 1)?"),
    ("llvm-exception", "llvm exception", r"apache(?: license)?(?: version)?(?: 2 0)? with llvm exceptions?|llvm exceptions?"),
    ("bison-exception", "bison", r"bison exception(?: 2 2)?"),
    ("font-exception", "font exception", r"gpl font exception|font exception 2 0"),
]

# Versions that a notice leaves open, or fixes: what stands before "or later" and "only". They hold the plain name, so they come before it.
VERSIONS = [
    ("gpl-1", "gnu general", rf"gnu general public {_L}{_V}1(?: 0)?"), ("gpl-1", "gpl", r"(?:gnu )?gpl ?v?(?:ersion)? ?1(?: 0)?"),
    ("gpl-2", "gnu general", rf"gnu general public {_L}{_V}2(?: 0)?"), ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?(?:ersion)? ?2(?: 0)?"),
    ("gpl-3", "gnu general", rf"gnu general public {_L}{_V}3(?: 0)?"), ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("lgpl-2", "library general", rf"(?:gnu )?library general public {_L}{_V}2(?: 0)?"), ("lgpl-2", "lgpl", r"(?:gnu )?lgpl ?v?(?:ersion)? ?2(?: 0)?"),
    ("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general public {_L}{_V}2 1"), ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?(?:ersion)? ?2 1"),
    ("lgpl-3", "lesser general", rf"(?:gnu )?lesser general public {_L}{_V}3(?: 0)?"), ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("agpl-3", "affero general", rf"(?:gnu )?affero general public {_L}{_V}3(?: 0)?"), ("agpl-3", "agpl", r"(?:gnu )?agpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {_L}{_V}1 [123]"), ("gfdl", "gfdl", r"gfdl ?v?1 [123]"),
    ("mpl-2", "mozilla", rf"mozilla public {_L}{_V}2(?: 0)?"), ("mpl-2", " mpl", r"mpl ?v?2(?: 0)?"),
    ("epl-2", "eclipse", rf"eclipse public {_L}{_V}2(?: 0)?"), ("epl-2", " epl", r"epl ?v?2(?: 0)?"),
]
for _label, _gate, _name in VERSIONS:
    NAMES.insert(0, (f"{_label}-or-later", _gate, rf"(?:{_name})(?: or)?(?: at your option)? (?:any )?later(?: versions?)?"))
    NAMES.insert(0, (f"{_label}-only", _gate, rf"(?:{_name}) only"))

# "MIT licensed" and the like: the name stands before the word.
NAMES += [
    ("mit", "mit licen", r"mit licen[cs]ed"), ("apache-2", "apache", r"apache 2(?: 0)? licen[cs]ed"), ("apache-2", "apache", r"apache licen[cs]ed"), ("bsd", "bsd licen", r"bsd licen[cs]ed"), ("bsd", "bsd", rf"(?:the )?bsd(?: style)? {_L}"),
    ("gpl", "gpl licen", r"gpl licen[cs]ed"), ("lgpl", "lgpl licen", r"lgpl licen[cs]ed"), ("agpl-3", "agpl licen", r"agpl licen[cs]ed"), ("gpl-2", "gplv2 licen", r"gplv2 licen[cs]ed"), ("gpl-3", "gplv3 licen", r"gplv3 licen[cs]ed"),
    ("mpl-2", "mpl licen", r"mpl licen[cs]ed"), ("cc0-1.0", "cc0 licen", r"cc0 licen[cs]ed"), ("isc", "isc licen", r"isc licen[cs]ed"), ("zlib", "zlib licen", r"zlib licen[cs]ed"), ("cc-by", "cc by licen", r"cc by licen[cs]ed"),
]

# Creative Commons: by the parts of the short name, with and without a version.
for _code, _words in (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
):
    _short = _code.replace("-", " ")
    NAMES.append((f"cc-{_code}", "cc by", rf"cc {_short}(?! (?:nc|nd|sa)\b)(?: \d \d)?"))
    NAMES.append((f"cc-{_code}", "creative commons", rf"creative commons {_words}(?! (?:non|no|share) ?(?:commercial|deriv|alike))(?: \d \d)?(?: (?:international|unported|generic))?(?: (?:public )?{_L})?"))
    NAMES.append((f"cc-{_code}", "creativecommons", rf"creativecommons org licenses {_short}(?! (?:nc|nd|sa)\b)(?: \d \d)?"))

# Short identifiers, which alone mean little: only in a tag, notice or field. The gate stands between blanks.
SHORT = [
    ("mit", " mit ", r"mit"), ("mit", " expat ", r"expat"), ("isc", " isc ", r"isc"), ("zlib", " zlib ", r"zlib"), ("libpng", " libpng", r"libpng(?: 2(?: 0)?)?"),
    ("bsl-1.0", " bsl 1", r"bsl 1(?: 0)?"), ("busl-1.1", " busl 1", r"busl 1 1"), ("sspl-1", " sspl", r"sspl(?: v?1(?: 0)?)?"), ("elastic-2", " elastic 2", r"elastic 2(?: 0)?"),
    ("epl-2", " epl", r"epl ?v? ?2(?: 0)?"), ("epl-1", " epl", r"epl ?v? ?1(?: 0)?"), ("edl-1", " edl", r"edl(?: ?v?1(?: 0)?)?"),
    ("artistic-2", " artistic 2", r"artistic 2(?: 0)?"), ("artistic-1", " artistic 1", r"artistic 1(?: 0)?"),
    ("gpl-1", " gpl", r"gpl ?v? ?1(?: 0)?"), ("gpl", " gpl ", r"gpl"), ("lgpl-2", " lgpl", r"lgpl ?v? ?2(?: 0)?"), ("lgpl", " lgpl ", r"lgpl"), ("agpl-3", " agpl ", r"agpl"),
    ("gfdl", " gfdl", r"gfdl(?: ?v?1 [123])?"), ("mpl-1.1", " mpl", r"mpl ?v? ?1 1"), ("mpl-1.0", " mpl", r"mpl ?v? ?1 0"),
    ("cpl-1.0", " cpl", r"cpl(?: ?v?1 0)?"), ("cpal-1.0", " cpal", r"cpal(?: ?v?1 0)?"), ("python-2", " python 2", r"python 2 0"), ("python-2", " psf", r"psf(?: 2 0)?"),
    ("php-3.01", " php 3", r"php 3 01"), ("ruby", " ruby ", r"ruby"), ("perl", " perl", r"perl(?: 5)?"), ("upl-1.0", " upl", r"upl(?: ?v?1 0)?"),
    ("osl-3", " osl", r"osl ?v? ?3(?: 0)?"), ("afl-3", " afl", r"afl ?v? ?3(?: 0)?"), ("ecl-2", " ecl", r"ecl ?v? ?2(?: 0)?"),
    ("ofl-1.1", " ofl", r"(?:sil )?ofl(?: ?v?1 1)?"), ("odc-by-1.0", " odc by", r"odc by(?: 1 0)?"), ("pddl-1.0", " pddl", r"pddl(?: 1 0)?"), ("ncsa", " ncsa ", r"ncsa"),
    ("postgresql", " postgresql ", r"postgresql"), ("openssl", " openssl ", r"openssl"), ("vim", " vim ", r"vim"), ("w3c", " w3c ", r"w3c"), ("x11", " x11 ", r"x11"), ("curl", " curl ", r"curl"),
    ("unicode", " unicode ", r"unicode(?: (?:3 0|tou|dfs 201[56]))?"), ("intel", " intel ", r"intel"), ("nasa-1.3", " nasa 1", r"nasa 1 3"), ("qpl-1.0", " qpl", r"qpl(?: ?v?1 0)?"),
    ("sleepycat", " sleepycat ", r"sleepycat"), ("zpl-2.1", " zpl", r"zpl ?v? ?2 1"), ("mulan-psl-2", " mulanpsl", r"mulanpsl ?v?2(?: 0)?"),
    ("llama", " llama", r"llama ?\d(?: \d)?"), ("beerware", " beer", r"beer ?ware"), ("jsr", " jrl ", r"jrl"),
]
#: Identifiers that are also plain words: a notice must say "licensed", and a field is less sure.
PLAIN = {"ruby", "perl", "postgresql", "openssl", "vim", "w3c", "x11", "curl", "unicode", "intel", "llama", "libpng", "zlib"}

# Passages of license bodies, by hand.
BODIES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd-3-clause", "neither the name", r"neither the name (?:of )?[^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache", r"www apache org licenses license 2 0"),
    ("gpl-3-or-later", "gnu", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2-or-later", "gnu", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "gnu", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3-or-later", "gnu", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-or-later", "gnu", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2-only", "gnu", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", "gnu", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "gnu", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl", "gnu", r"see the gnu general public license for more details"),
    ("agpl-3", "affero", r"gnu affero general public license as published by the free software foundation"),
    ("lgpl", "lesser", r"gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "boost", r"boost org license 1 0 txt"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain|this work is in the public domain"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("proprietary", "all rights", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "may not be", r"may not be (?:reproduced|copied|redistributed)(?: or (?:distributed|used|copied|redistributed))? without (?:the )?(?:prior |express )*(?:written )?permission"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution) (?:of|is)"),
]

# What stands before a name, and how sure it makes the scan; in order of priority.
FORMS = [
    ("tag", r"spdx license identifier {0}(?: only| or later)?", 1.0),
    ("notice", r"(?:(?:this|the) (?:work|file|software|program|project|text|code|document|package|library) is )?(?:dual )?(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|made available|covered|offered|shared|governed)(?: [^ ]+){{0,3}}? (?:under|by|with|via|subject to)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?(?: an?)? {0}", 0.95),
    ("field", r"licen[cs]es?(?: is| are| name| type| info| information)? {0}", 0.85),
    ("name", r"{0}", 0.7),
]
# The same before a short identifier. Only "under" leads to one: software is also distributed with, or provided by, what bears such a name.
_UNDER = r" under(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?(?: an?)? {0}"
SHORT_FORMS = {
    "tag": (FORMS[0][1], FORMS[0][1]),
    "notice": (r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|offered|shared|governed)(?: [^ ]+){{0,3}}?" + _UNDER, r"licen[cs]ed" + _UNDER),
    "field": (FORMS[2][1], FORMS[2][1]),
}


def _rules() -> list[tuple[str, bytes, re.Pattern, float]]:
    """Label, gate, pattern and certainty, by priority: bodies, then each form over every name and short identifier, then bare mentions."""
    word = r"(?<![^ ])(?:{})(?![^ ])"
    make = lambda p: re.compile(word.format(p).encode())
    rules = [(label, gate.encode(), make(p), 1.0 if label != "proprietary" else 0.6) for label, gate, p in BODIES]
    for kind, form, sure in FORMS:
        rules += [(label, gate.encode(), make(form.format(f"(?:{p})")), sure) for label, gate, p in NAMES]
        for label, gate, p in SHORT if kind in SHORT_FORMS else []:
            plain = label in PLAIN
            rules.append((label, gate.encode(), make(SHORT_FORMS[kind][plain].format(f"(?:{p})")), 0.6 if plain and kind == "field" else sure))
    return rules


RULES = _rules()
_BY_GATE: dict[bytes, list[int]] = {}
for _i, _rule in enumerate(RULES):
    _BY_GATE.setdefault(_rule[1], []).append(_i)
_BASE = [(re.compile(rb"(?<![^ ])(?=" + p + rb"(?![^ ]))"), label) for p, label in BASE]
#: A text with none of these holds nothing that any rule could match: every string that a rule matches holds one.
_MAIN = [b"licen", b" mit ", b"gpl", b"cc by", b"creative", b"public domain", b"all rights", b"permission", b"redistrib", b"spdx", b"gnu", b"cc0", b"apache", b"bsd", b"as is", b"confidential", b"may not be", b"unauthorized", b"neither the", b"advertising", b"wtfpl", b"rail", b"mulan psl", b"ms pl", b"ms rl", b"mpl", b"eupl", b"odbl", b"cddl", b"under ", b"cecill", b"boost org", b"same terms", b"nasa open", b"exception", b"gemma", b"lizenz", b"lppl", b"cern ohl", b"gfdl", b" epl", b"commons clause"]


def detect(folded: bytes) -> list[tuple[int, int, str, float, int]]:
    """Accepted detections of a folded text that starts and ends with a blank: begin, end, label, certainty, rule."""
    accepted: list[tuple[int, int, str, float, int]] = []
    if not any(x in folded for x in _MAIN):
        return accepted
    order = sorted(i for gate, own in _BY_GATE.items() if gate in folded for i in own)
    # accepted intervals that no other one contains: as begins rise, so do ends
    begins, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in order:
        label, _, pattern, sure = RULES[i]
        spans = [m.span() for m in pattern.finditer(folded)]
        if not spans:
            continue
        own = np.array(spans, np.int64)
        if len(begins):
            at = np.searchsorted(begins, own[:, 0], "right") - 1
            own = own[(at < 0) | (ends[at] < own[:, 1])]
            if not len(own):
                continue
        accepted += [(a, b, label, sure, i) for a, b in own.tolist()]
        begins, ends = np.append(begins, own[:, 0]), np.append(ends, own[:, 1])
        rank = np.lexsort((-ends, begins))
        begins, ends = begins[rank], ends[rank]
        outer = np.append(True, ends[1:] > np.maximum.accumulate(ends)[:-1])
        begins, ends = begins[outer], ends[outer]
    return sorted(accepted)


def base_places(folded: bytes) -> list[tuple[int, str]]:
    return sorted((m.start(), label) for (phrase, _), (pattern, label) in zip(BASE, _BASE, strict=True) if phrase in folded for m in pattern.finditer(folded))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, the base phrases' places and labels, and all labels with the surest detection's score.

    One row comes back for each row, repeated ids and texts included. Null and empty
    texts have no words, null places, empty label strings and score 0. Other columns
    are not read. An empty table gives no rows.
    """

    def kernel(ids: pa.Array, texts: pa.Array) -> dict:
        data, offsets = flat(texts)
        raw, edges = data.tobytes().translate(_FOLD), offsets.tolist()
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            words = raw[a:b].split()
            folded = b" " + b" ".join(words) + b" "
            base, found = base_places(folded), detect(folded)
            blanks = np.cumsum(np.frombuffer(folded, np.uint8) == 32) if base else None
            at = [int(blanks[p - 1]) - 1 for p, _ in base]
            own = sorted({x for _, x in base})
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min(at, default=None))
            out["last_word"].append(max(at, default=None))
            out["base_labels"].append(",".join(own))
            out["labels"].append(",".join(sorted({*own, *(x[2] for x in found)})))
            out["score"].append(max([*(x[3] for x in found), *[0.95] * bool(base)], default=0.0))
            out["n_detections"].append(len(found))
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64(), "n_detections": pa.int64()}
        return {"doc_id": ids, **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}}

    kind = dict(df.dtypes)[id_col]
    return map_texts(df, kernel, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long", id_col, text_col)
