"""Notices that licence scans look for; all are fixed values."""

from __future__ import annotations

#: Phrases of the base scan and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Fixed values: (label, notice, key phrases that must stand in a match).
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("apache-2.0", "This work is licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", ("general public license",)),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby", "free of charge")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("public-domain", "dedicated to the public domain under CC0 1.0 Universal", ("public domain",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)
