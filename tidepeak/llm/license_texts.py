"""Passages of well-known licences, each with the phrases that must stand in full in it (fixed values)."""

#: Label, passage, key phrases.
PASSAGES = (
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("mit-release", "released under the mit license", ("mit license",)),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("hereby granted free of charge", "deal in the software without restriction"),
    ),
    (
        "mit-text",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("copies or substantial portions of the software",),
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee is hereby granted", "appear in all copies"),
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    (
        "bsd-text",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ("redistributions of source code must retain",),
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "either version 3 of the license"),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"
        " either version 2 of the License, or (at your option) any later version.",
        ("gnu general public license", "either version 2 of the license"),
    ),
    (
        "agpl-3.0",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        ("gnu affero general public license",),
    ),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ("unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("granted to anyone to use this software", "redistribute it freely"),
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ("person or organization obtaining a copy", "accompanying documentation covered by this license"),
    ),
)
