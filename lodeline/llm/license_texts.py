"""Licence texts and notices as lower-cased words: (label, mandatory phrase, text). Fixed values.

Whole texts of public licences, from their first sentence on, without the copyright line, which
differs from file to file; the notices that licences ask files to carry; and short notices.
"""

_PERMISSIVE_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_REDISTRIBUTION = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_ENDORSEMENT = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
)
_FREE_SOFTWARE = (
    "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license or at your option any later version "
    "{0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1} for more details "
    "you should have received a copy of the gnu {1} along with {0} if not see https www gnu org licenses"
)

TEMPLATES = (
    # whole texts
    (
        "mit",
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("bsd", "redistribution and use in source and binary forms", _REDISTRIBUTION + _PERMISSIVE_END),
    ("bsd", "redistribution and use in source and binary forms", _REDISTRIBUTION + _ENDORSEMENT + _PERMISSIVE_END),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity "
        "of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
        "or in connection with the software or the use or other dealings in the software",
    ),
    # notices that files carry
    (
        "apache",
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "gnu general public license", _FREE_SOFTWARE.format("this program", "general public license", "3")),
    ("lgpl", "gnu lesser general public license", _FREE_SOFTWARE.format("this library", "lesser general public license", "3")),
    ("agpl", "gnu affero general public license", _FREE_SOFTWARE.format("this program", "affero general public license", "3")),
    (
        "mpl",
        "mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "epl",
        "eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    ),
    (
        "cc0",
        "dedicated the work to the public domain",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law "
        "including all related and neighboring rights to the extent allowed by law you can copy modify distribute and perform the work even for commercial purposes all without asking permission",
    ),
    # short notices
    ("mit", "mit license", "released under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license version 2 0"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("isc", "isc license", "released under the isc license"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("cc0", "cc0 1 0", "dedicated to the public domain under cc0 1 0 universal"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
)
