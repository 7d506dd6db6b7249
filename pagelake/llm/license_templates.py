"""Licence wordings as template markup.

Fixed values: the wording of public licences, each to its end, and of the usual notices. Parts of a licence that stand
alone in texts have labels of their own (``mit-grant``). ``<<beginOptional>>`` to
``<<endOptional>>`` may be left out, ``<<var;name=...;match=...>>`` stands for other wording: ``a|b`` is
one word of these, ``.{m,n}`` is m to n words of any kind. All else is mandatory wording.
"""

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
    substantial portions of the Software."""
ISC_GRANT = """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
    without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions
    in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3.<<endOptional>>
    Neither the name of <<var;name=holder;match=.{1,20}>> nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission.<<endOptional>>"""
ZLIB_DISCLAIMER = """This software is provided 'as-is', without any express or implied warranty. In no event will the
    <<var;name=holder;match=.{1,10}>> be held liable for any damages arising from the use of this software."""

TEMPLATES = {
    "mit-notice": "<<var;name=verb;match=released|licensed|distributed|available|published>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "apache-2.0": "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0",
    "gpl-3.0": "<<var;name=verb;match=licensed|released|distributed>> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License, <<beginOptional>>version<<endOptional>> 3",
    "gpl-2.0": "<<var;name=verb;match=licensed|released|distributed>> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License, <<beginOptional>>version<<endOptional>> 2",
    "gpl-later": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version <<var;name=version;match=1|2|3>> of the License, or (at your option) any later version",
    "cc-by-4.0": "<<var;name=verb;match=licensed|released|published>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0",
    "cc-by-nc-4.0": "<<var;name=verb;match=licensed|released|published>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "<<var;name=verb;match=licensed|released|published>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-SA 4.0",
    "mit-grant": MIT_GRANT,
    "mit": MIT_GRANT
    + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;match=.{0,12}>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-grant": ISC_GRANT,
    "isc": ISC_GRANT
    + """ THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;match=.{1,12}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=holder;match=.{1,12}>> BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
        OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-conditions": BSD_CONDITIONS,
    "bsd": BSD_CONDITIONS
    + """ THIS SOFTWARE IS PROVIDED BY <<var;name=holder;match=.{1,12}>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL <<var;name=holder;match=.{1,12}>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-disclaimer": ZLIB_DISCLAIMER,
    "zlib": ZLIB_DISCLAIMER
    + """ Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software
        must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "all-rights-reserved": "<<beginOptional>>Copyright <<var;name=holder;match=.{0,12}>><<endOptional>> All rights reserved",
}
