"""Names of numbered properties in scripts of old versions, by kind of property and number."""

from __future__ import annotations

# Fixed values of the format: a number's place in its list is its place here, counted from the number given.
MOVIE = (0, ("floatPrecision", "mouseDownScript", "mouseUpScript", "keyDownScript", "keyUpScript", "timeoutScript", "short time", "abbr time", "long time", "short date", "abbr date", "long date"))
EVENTS = (1, ("mouseDown", "mouseUp", "keyDown", "keyUp", "timeOut"))
MENU = (1, ("name", "number of menuItems"))
MENU_ITEM = (1, ("name", "checkMark", "enabled", "script"))
SOUND = (1, ("volume",))
SPRITE = (1, (
    "type", "backColor", "bottom", "castNum", "constraint", "cursor", "foreColor", "height", "immediate", "ink", "left",
    "lineSize", "locH", "locV", "movieRate", "movieTime", "pattern", "puppet", "right", "startTime", "stopTime",
    "stretch", "top", "trails", "visible", "volume", "width", "blend", "scriptNum", "moveableSprite", "editableText",
    "scoreColor", "loc", "rect", "memberNum", "castLibNum", "member", "scriptInstanceList", "currentTime",
    "mostRecentCuePoint", "tweened", "name",
))
ANIMATION = (1, (
    "beepOn", "buttonStyle", "centerStage", "checkBoxAccess", "checkboxType", "colorDepth", "colorQD", "exitLock",
    "fixStageSize", "fullColorPermit", "imageDirect", "doubleClick", "key", "lastClick", "lastEvent", "keyCode",
    "lastKey", "lastRoll", "timeoutLapsed", "multiSound", "pauseState", "quickTimePresent", "selEnd", "selStart",
    "soundEnabled", "soundLevel", "stageColor", None, "switchColorDepth", "timeoutKeyDown", "timeoutLength",
    "timeoutMouse", "timeoutPlay", "timer", "preLoadRAM", "videoForWindowsPresent", "netPresent", "safePlayer",
    "soundKeepDevice", "soundMixMedia",
))
COUNTS = (1, ("perFrameHook", "number of castMembers", "number of menus", "number of castLibs", "number of xtras"))
MEMBER = (1, (
    "name", "text", "textStyle", "textFont", "textHeight", "textAlign", "textSize", "picture", "hilite", "number",
    "size", "loop", "duration", "controller", "directToStage", "sound", "foreColor", "backColor", "type",
))


def named(table: tuple[int, tuple], number: int) -> str:
    """A property's name, ERROR for a number that has none."""
    first, names = table
    return (names[number - first] if 0 <= number - first < len(names) else None) or "ERROR"
